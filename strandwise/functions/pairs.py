"""Column functions on an alignment's two rows: gapped strings, difference strings, clips, padding, tags, mates.

A pair is a struct (q, t): the query and the target with '-' where the other has a base of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg
from strandwise.functions.flags import has
from strandwise.functions.sequence import kmer_code, letters, reverse_complement

GAP, PAD = "-", "*"
WORD = 31  # bases in one packed long


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once: a lambda's argument, unlike a column that is used twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def gapped(cigar: Column, seq: Column, target: Column) -> Column:
    """The pair; target begins at the alignment's position. Clips and skipped stretches (N) aren't shown."""
    ops = F.filter(cg.with_offsets(cigar), lambda x: x["op"].isin("M", "=", "X", "I", "D") & (x["len"] > 0))
    row = lambda ops, text, at, without: F.array_join(F.transform(ops, lambda x: F.when(x["op"] == without, F.repeat(F.lit(GAP), x["len"])).otherwise(F.substring(text, x[at] + 1, x["len"]))), "")
    return bound(ops, lambda o: F.struct(row(o, seq, "q", "D").alias("q"), row(o, target, "r", "I").alias("t")))


def columns(pair: Column) -> Column:
    """Array of (q, t): the letters of each column in upper case."""
    return F.zip_with(letters(F.upper(pair["q"])), letters(F.upper(pair["t"])), lambda q, t: F.struct(q.alias("q"), t.alias("t")))


def differences(pair: Column) -> Column:
    """Columns whose letters differ: mismatches, inserted and deleted bases (the NM tag)."""
    return F.size(F.filter(columns(pair), lambda x: x["q"] != x["t"])).cast("long")


def identity(pair: Column) -> Column:
    """Equal columns over all columns; null of an empty pair."""
    n = F.length(pair["q"])
    return F.when(n > 0, 1 - differences(pair) / n)


def md(pair: Column) -> Column:
    """The MD tag: lengths of equal runs, the target's base at a mismatch, ^ and the target's bases at a deletion."""
    shown = F.transform(columns(pair), lambda x: F.when(x["t"] == GAP, "").when(x["q"] == GAP, F.lower(x["t"])).when(x["q"] == x["t"], ".").otherwise(x["t"]))
    code, event = F.concat(F.array_join(shown, ""), F.lit("$")), r"(\.*)([A-Z]|[a-z]+|\$)"
    each = lambda c, i: F.regexp_extract_all(c, F.lit(event), F.lit(i))
    name = lambda e: F.when(e == "$", "").when(e == F.lower(e), F.concat(F.lit("^"), F.upper(e))).otherwise(e)
    return bound(code, lambda c: F.array_join(F.zip_with(each(c, 1), each(c, 2), lambda r, e: F.concat(F.length(r).cast("string"), name(e))), ""))


def cs(pair: Column) -> Column:
    """The short difference string: :length, *target query, +inserted, -deleted."""
    q, t = (lambda x: F.lower(x["q"])), (lambda x: F.lower(x["t"]))
    each = F.transform(columns(pair), lambda x: F.when(x["q"] == x["t"], ".").when(x["t"] == GAP, F.concat(F.lit("+"), q(x))).when(x["q"] == GAP, F.concat(F.lit("-"), t(x))).otherwise(F.concat(F.lit("*"), t(x), q(x))))
    runs = F.regexp_extract_all(F.array_join(each, ""), F.lit(r"(\.+|\*..|(?:\+[a-z])+|(?:-[a-z])+)"), F.lit(1))
    joined = lambda x: F.concat(F.substring(x, 1, 1), F.regexp_replace(x, "[+-]", ""))
    return F.array_join(F.transform(runs, lambda x: F.when(F.startswith(x, F.lit(".")), F.concat(F.lit(":"), F.length(x).cast("string"))).when(F.startswith(x, F.lit("*")), x).otherwise(joined(x))), "")


def exact_ends(pair: Column, k: int = 8, least: int = 500) -> Column:
    """(q, t, skipped): the pair from its first to its last k equal columns in a row, and the target's bases before
    it; null if fewer than least columns remain."""
    agree = lambda p: F.array_join(F.transform(columns(p), lambda x: F.when(x["q"] == x["t"], "=").otherwise("x")), "")
    ends = lambda a: F.struct(F.locate("=" * k, a).alias("first"), (F.length(a) - F.locate("=" * k, F.reverse(a)) + 1).alias("last"))

    def cut(p: Column, e: Column) -> Column:
        n = e["last"] - e["first"] + 1
        skipped = F.length(F.replace(F.substring(p["t"], F.lit(1), e["first"] - 1), F.lit(GAP), F.lit("")))
        return F.when((e["first"] > 0) & (n >= least), F.struct(F.substring(p["q"], e["first"], n).alias("q"), F.substring(p["t"], e["first"], n).alias("t"), skipped.alias("skipped")))

    return bound(pair, lambda p: bound(bound(agree(p), ends), lambda e: cut(p, e)))


def clip_to_window(pos: Column, cigar: Column, beg: Column, end: Column) -> Column:
    """(pos, qbeg, cigar): the part of an alignment on the reference's [beg, end). An insertion belongs to the base
    before it; clips go. pos is null if nothing remains."""
    lo, hi = beg - pos, end - pos

    def part(x: Column) -> Column:
        left = F.greatest(x["r"].cast("long"), lo)
        n = F.when(x["op"] == "I", F.when((x["r"] > lo) & (x["r"] <= hi), x["len"]).otherwise(0)).when(x["op"].isin(*cg.ON_REFERENCE), F.least(x["r"] + x["len"], hi) - left).otherwise(0)
        q = x["q"] + F.when(x["op"].isin("M", "=", "X"), left - x["r"]).otherwise(0)
        return F.struct(x["op"].alias("op"), n.cast("int").alias("len"), q.alias("q"), left.alias("r"))

    kept = F.filter(F.transform(cg.with_offsets(cigar), part), lambda x: x["len"] > 0)
    first = lambda k: F.get(k, F.lit(0))
    return bound(kept, lambda k: F.struct((pos + first(k)["r"]).alias("pos"), first(k)["q"].alias("qbeg"), F.transform(k, lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"))).alias("cigar")))


def run_lengths(ops: Column) -> Column:
    """'MMMID' -> CIGAR array."""
    return F.transform(F.regexp_extract_all(ops, F.lit(r"((.)\2*)"), F.lit(1)), lambda x: F.struct(F.substring(x, 1, 1).alias("op"), F.length(x).alias("len")))


def depad(pos: Column, cigar: Column, padded: Column) -> Column:
    """(pos, cigar) on the reference without its pads (*): a base under a pad becomes an insertion, a deletion of a pad
    goes."""
    drop = lambda s: F.replace(s, F.lit(PAD), F.lit(""))
    under = lambda x: F.substring(padded, (pos + x["r"] + 1).cast("int"), x["len"])
    matched = lambda x: F.regexp_replace(F.regexp_replace(under(x), r"[^*]", "M"), r"\*", "I")
    shown = F.transform(cg.with_offsets(cigar), lambda x: F.when(x["op"].isin("M", "=", "X"), matched(x)).when(x["op"].isin("D", "N"), F.repeat(x["op"], F.length(drop(under(x))))).otherwise(F.repeat(x["op"], x["len"])))
    return F.struct(F.length(drop(F.substring(padded, F.lit(1), pos.cast("int")))).cast("long").alias("pos"), run_lengths(F.array_join(shown, "")).alias("cigar"))


def template_cigar(first: Column, second: Column) -> Column:
    """The ct tag of two mates, structs (tid, pos, flag, cigar): the leftmost's number, strand and CIGAR, the distance to
    the other (negative if they overlap) and T, then the other's. Null unless both lie on one contig."""
    placed = (first["tid"] == second["tid"]) & (first["tid"] >= 0) & ~has(first["flag"], "UNMAP") & ~has(second["flag"], "UNMAP")
    shown = lambda m: F.concat(F.when(has(m["flag"], "READ1"), "1").otherwise("2"), F.when(has(m["flag"], "REVERSE"), "R").otherwise("F"), cg.text(m["cigar"]))
    between = lambda a, b: F.concat(shown(a), (b["pos"] - a["pos"] - cg.reference_span(a["cigar"])).cast("string"), F.lit("T"), shown(b))
    return F.when(placed, F.when(first["pos"] > second["pos"], between(second, first)).otherwise(between(first, second)))


def set_tag(tags: Column, name: str, value: Column) -> Column:
    """tags (map) with name added or replaced; a null value drops it."""
    others = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return F.when(value.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(name), value.cast("string"))))


def drop_tags(tags: Column, *names: str) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*names))


def pack(seq: Column) -> Column:
    """Longs of 31 bases, two bits each; the last holds what remains. Null where a letter isn't A, C, G or T."""
    n = F.ceil(F.length(seq) / WORD).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: kmer_code(F.substring(seq, i * WORD + 1, F.lit(WORD))))).otherwise(F.array().cast("array<bigint>"))


def unpack(words: Column, length: Column) -> Column:
    digits = lambda w, i: F.translate(F.lpad(F.conv(w.cast("string"), 10, 4), F.least(F.lit(WORD), length - i * WORD).cast("int"), F.lit("0")), "0123", "ACGT")
    return F.array_join(F.transform(words, digits), "")


def packed_substring(words: Column, length: Column, beg: Column, end: Column, reverse: Column | None = None) -> Column:
    """Bases [beg, end) of a packed sequence, reverse complemented where reverse is true. Only the words that the stretch
    touches are unpacked."""
    at = F.floor(beg / WORD).cast("int")
    some = F.slice(words, at + 1, F.greatest(F.ceil(end / WORD).cast("int") - at, F.lit(0)))
    out = F.substring(unpack(some, length - at * WORD), (beg - at * WORD + 1).cast("int"), (end - beg).cast("int"))
    return out if reverse is None else F.when(reverse, reverse_complement(out)).otherwise(out)


def merge_mates(first: Column, second: Column, least: int = 10, share: float = 0.9) -> Column:
    """One sequence of two mates that read into each other: the longest overlap of the first's end with the start of the
    second's reverse complement in which that share of bases agrees; null if there is none of at least least bases."""
    alike = lambda n, other: F.size(F.filter(F.zip_with(letters(F.right(first, n)), letters(F.left(other, n)), lambda a, b: a == b), lambda same: same))

    def merged(other: Column) -> Column:
        most = F.least(F.length(first), F.length(other))
        fits = F.when(most >= least, F.filter(F.sequence(most, F.lit(least), F.lit(-1)), lambda n: alike(n, other) >= n * share))
        return bound(F.try_element_at(fits, F.lit(1)), lambda n: F.when(n.isNotNull(), F.concat(first, F.substring(other, n + 1, F.length(other)))))

    return bound(reverse_complement(second), merged)
