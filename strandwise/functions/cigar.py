"""Column functions on CIGARs: arrays of (op, len) in the order of the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each operation consumes.
ON_REFERENCE, ON_QUERY, CLIPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("S", "H")
ARRAY = "array<struct<op:string,len:int>>"


def parse(text: Column) -> Column:
    """'3S10M' -> array; '*' and null give null."""
    each = F.regexp_extract_all(text, F.lit(r"([0-9]+[MIDNSHP=XB])"), F.lit(1))
    one = lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("len"))
    return F.when(text != "*", F.transform(each, one))


def text(cigar: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""), F.lit("*"))


def total(cigar: Column, ops: tuple[str, ...]) -> Column:
    """The summed lengths of the operations."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_span(cigar: Column) -> Column:
    return total(cigar, ON_REFERENCE)


def query_span(cigar: Column, hard: bool = False) -> Column:
    return total(cigar, ON_QUERY + (("H",) if hard else ()))


def end_position(pos: Column, cigar: Column, unmapped: Column) -> Column:
    """The end, exclusive; an unmapped record spans one position."""
    return pos + F.when(unmapped | F.coalesce(F.size(cigar) <= 0, F.lit(True)), F.lit(1)).otherwise(reference_span(cigar))


def clip_length(cigar: Column, at_end: bool, ops: tuple[str, ...] = CLIPS) -> Column:
    """The length of the outermost operation if it is a clip, else 0."""
    edge = F.try_element_at(cigar, F.lit(-1 if at_end else 1))
    return F.when(edge["op"].isin(*ops), edge["len"]).otherwise(0)


def all_clips(cigar: Column, at_end: bool) -> Column:
    """Soft and hard clips of one side together."""
    edge, inner = (F.try_element_at(cigar, F.lit(i)) for i in ((-1, -2) if at_end else (1, 2)))
    first = F.when(edge["op"].isin(*CLIPS), edge["len"]).otherwise(0)
    return first + F.when(edge["op"].isin(*CLIPS) & inner["op"].isin(*CLIPS), inner["len"]).otherwise(0)


def clip_ratio(cigar: Column, query_length: Column, hard: bool = False) -> Column:
    """Clipped share of the read, 0 if it has no sequence."""
    ops = CLIPS if hard else ("S",)
    return F.when(query_length > 0, (clip_length(cigar, False, ops) + clip_length(cigar, True, ops)) / query_length).otherwise(0.0)


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - all_clips(cigar, False)


def unclipped_end(pos: Column, cigar: Column) -> Column:
    return pos + reference_span(cigar) + all_clips(cigar, True)


def with_offsets(cigar: Column) -> Column:
    """Array of (op, len, q, r): the query and reference offsets where each operation begins."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<op:string,len:int,q:int,r:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = F.struct(x["op"].alias("op"), x["len"].alias("len"), a["q"].alias("q"), a["r"].alias("r"))
        q = a["q"] + F.when(x["op"].isin(*ON_QUERY), x["len"]).otherwise(0)
        r = a["r"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)
        return F.struct(q.alias("q"), r.alias("r"), F.concat(a["out"], F.array(own)).alias("out"))

    return F.aggregate(cigar, start, step)["out"]


def interval_bin(beg: Column, end: Column) -> Column:
    """The smallest bin of the five-level scheme that holds [beg, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.lit(first) + F.shiftright(beg, shift)).otherwise(out)
    return out


def trimmed_span(seq: Column, cigar: Column, trim: int = 2) -> tuple[Column, Column]:
    """Query offsets (beg, end) that count: beyond the soft clips, trim bases are dropped at each end, and more as long
    as the edge would cut a run of one letter."""
    beg = clip_length(cigar, False, ("S",)) + trim
    end = F.length(seq) - clip_length(cigar, True, ("S",)) - trim
    left, right = F.substring(seq, beg, F.length(seq)), F.reverse(F.substring(seq, F.lit(1), end + 1))
    run = lambda s: F.length(F.regexp_extract(s, r"^(.)\1*", 0)) - 1
    return beg + F.greatest(run(left), F.lit(0)), end - F.greatest(run(right), F.lit(0))
