"""Column functions on sequences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases and what pairs with each, upper and lower case, with the ambiguity codes.
BASES, PAIRED = "ACGTUNMRWSYKVHDBacgtunmrwsykvhdb", "TGCAANKYWSRMBDHVtgcaankywsrmbdhv"
#: The four-bit alphabet of alignment records; a letter's code is its place.
NT16 = "=ACMGRSVTWYHKDBN"
#: The consensus alphabet; a letter's code is its place.
CONSENSUS = "ATGC-NM"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, PAIRED))


def code_of(base: Column, alphabet: str) -> Column:
    """A base's place in the alphabet; null if it isn't in it."""
    at = F.instr(F.lit(alphabet), F.upper(base))
    return F.when((at > 0) & (F.length(base) == 1), at - 1)


def base_of(code: Column, alphabet: str) -> Column:
    """The letter at a place of the alphabet; null beyond it."""
    return F.when((code >= 0) & (code < len(alphabet)), F.substring(F.lit(alphabet), code.cast("int") + 1, F.lit(1)))


def two_bit(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; null for others."""
    return code_of(base, "ACGT")


def has_n(seq: Column) -> Column:
    return F.contains(F.upper(seq), F.lit("N"))


def homopolymer_compress(seq: Column) -> Column:
    """Each run of one letter becomes one letter."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgcSs]", ""))


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers in order; empty if the sequence is shorter. A look-ahead finds them in one pass; cutting them
    out by their places would scan the sequence from its beginning for each."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def letters(seq: Column) -> Column:
    """Array of the letters; an empty pattern splits without any matching."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base in a long; null if a letter isn't A, C, G or T. Up to 31 bases."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(kmer.rlike("^[ACGTacgt]+$"), F.conv(digits, 4, 10).cast("long"))


def invertible_hash(key: Column, bits: int) -> Column:
    """A one-to-one mixing of numbers below 2^bits (up to 54): xor-shifts and multiplications by odd numbers, which are
    short enough for no product to pass 62 bits."""
    mask = (1 << bits) - 1
    half = (bits + 1) // 2
    x = key
    for odd in (0x2545F491, 0x9E3779B1):
        odd = odd & ((1 << (62 - bits)) - 1) | 1
        x = x.bitwiseXOR(F.shiftrightunsigned(x, half))
        x = (x * F.lit(odd)).bitwiseAND(F.lit(mask))
    return x.bitwiseXOR(F.shiftrightunsigned(x, half))


def natural_key(name: Column) -> Column:
    """A sort key that compares runs of digits as numbers: each is led by its length without leading zeros."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def wrap(seq: Column, width: int) -> Column:
    """Line breaks after each width letters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def soft_mask_runs(seq: Column) -> Column:
    """Array of (beg, end) of the lower-case runs, 0-based and half-open."""
    runs = F.regexp_extract_all(seq, F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<beg:int,end:int>>").alias("out"))

    def step(a: Column, run: Column) -> Column:
        end = a["at"] + F.length(run)
        own = F.array(F.struct(a["at"].alias("beg"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(run.rlike("^[a-z]"), F.concat(a["out"], own)).otherwise(a["out"]).alias("out"))

    return F.aggregate(runs, start, step)["out"]
