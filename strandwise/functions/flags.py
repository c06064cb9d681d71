"""Alignment flags as columns and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg

#: The flag bits by name.
BITS = {
    "PAIRED": 0x1, "PROPER_PAIR": 0x2, "UNMAP": 0x4, "MUNMAP": 0x8, "REVERSE": 0x10, "MREVERSE": 0x20, "READ1": 0x40, "READ2": 0x80,
    "SECONDARY": 0x100, "QCFAIL": 0x200, "DUP": 0x400, "SUPPLEMENTARY": 0x800,
}


def has(flag: Column, *names: str) -> Column:
    bits = sum(BITS[n] for n in names)
    return flag.bitwiseAND(F.lit(bits)) == bits


def none_of(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == 0


def to_text(flag: Column) -> Column:
    """The names of the bits, joined by commas."""
    return F.concat_ws(",", *[F.when(has(flag, n), F.lit(n)) for n in BITS])


def from_text(names: Column) -> Column:
    """The flag that names joined by commas stand for; unknown names count nothing."""
    value = F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv])
    return F.aggregate(F.array_distinct(F.split(F.upper(names), ",")), F.lit(0), lambda a, n: a + F.coalesce(F.try_element_at(value, n), F.lit(0)))


def short_first(flag: Column) -> Column:
    """Short reads, first level: mapped, no duplicate, not supplementary."""
    return none_of(flag, 0xC04)


def short_level(flag: Column, mapq: Column, cigar: Column, query_length: Column, isize: Column, insert_limit: Column | int, min_mapq: int = 0) -> Column:
    """Short reads in two levels: 0 rejected, 1 usable (insert in range, or little clipped), 2 confident."""
    ratio = cg.clip_ratio(cigar, query_length)
    near = has(flag, "PAIRED") & (F.abs(isize) > 0) & (F.abs(isize) < insert_limit)
    usable = short_first(flag) & (near | (ratio < 0.15))
    return F.when(usable & (mapq >= min_mapq) & (ratio < 0.20), 2).when(usable, 1).otherwise(0)


def long_phasing(flag: Column, cigar: Column, query_length: Column) -> Column:
    """Long reads for phasing: primary alignments, at most 0.4 clipped."""
    return none_of(flag, 0xD04) & (cg.clip_ratio(cigar, query_length, hard=True) <= 0.4)


def long_consensus(flag: Column, cigar: Column, query_length: Column, least_share: float = 0.7, least_length: int = 500, bridges: Column | None = None) -> Column:
    """Long reads for consensus: primary, aligned for over least_share of their length (unless they bridge a gap)."""
    aligned = query_length - cg.clip_length(cigar, False) - cg.clip_length(cigar, True)
    enough = aligned / query_length > least_share
    return none_of(flag, 0xD04) & (enough if bridges is None else enough | bridges) & (aligned >= least_length)


def view(flag: Column, mapq: Column, query_length: Column, all_of: int = 0, none: int = 0, not_all: int = 0, min_mapq: int = 0, min_length: int = 0) -> Column:
    """The record filter of a viewer: bits that must all be set, must all be clear, mustn't all be set."""
    out = (mapq >= min_mapq) & (query_length >= min_length) & none_of(flag, none) & (flag.bitwiseAND(F.lit(all_of)) == all_of)
    return out & (flag.bitwiseAND(F.lit(not_all)) != not_all) if not_all else out


def countable(flag: Column) -> Column:
    """What depth and interval coverage count: no unmapped, secondary, failed or duplicate reads."""
    return none_of(flag, 0x704)


def sampled(name: Column, share: float, seed: int = 0) -> Column:
    """About that share of the names, always the same ones: mates stay together."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), name).cast("binary")), F.lit(1 << 20)) < int(share * (1 << 20))
