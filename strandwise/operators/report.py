"""Reports over alignments: counters, histograms, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.flags import has, none_of
from strandwise.functions.sequence import letters


def flagstat(aln: DataFrame) -> DataFrame:
    """aln(flag, tid, mtid, mapq) -> what, passed, failed: thirteen counters for records that passed quality and not."""
    f = F.col("flag")
    primary, mapped = none_of(f, 0x900), none_of(f, 0x4)
    pair = primary & has(f, "PAIRED")
    both = pair & none_of(f, 0xC)
    apart = both & (F.col("tid") != F.col("mtid"))
    counters = {
        "total": F.lit(True), "secondary": has(f, "SECONDARY"), "supplementary": has(f, "SUPPLEMENTARY"), "duplicates": has(f, "DUP"), "mapped": mapped,
        "paired": pair, "read1": pair & has(f, "READ1"), "read2": pair & has(f, "READ2"), "proper": pair & has(f, "PROPER_PAIR") & mapped,
        "both_mapped": both, "singletons": pair & mapped & has(f, "MUNMAP"), "apart": apart, "apart_mapq5": apart & (F.col("mapq") >= 5),
    }
    fail = has(f, "QCFAIL")
    one = aln.agg(*[F.count_if(c & (fail if side else ~fail)).alias(f"{k}_{side}") for k, c in counters.items() for side in (0, 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"{k}_0").alias("passed"), F.col(f"{k}_1").alias("failed")) for k in counters])).alias("r")
    return one.select(rows).select("r.*")


def idxstats(aln: DataFrame, targets: DataFrame) -> DataFrame:
    """aln(tid, flag), targets(tid, len) -> tid, len, mapped, unmapped; contigs without reads have zeros."""
    n = aln.groupBy("tid").agg(F.count_if(none_of(F.col("flag"), 4)).alias("mapped"), F.count_if(has(F.col("flag"), "UNMAP")).alias("unmapped"))
    zero = F.lit(0).cast("long")
    return targets.join(n, "tid", "left").select("tid", "len", F.coalesce("mapped", zero).alias("mapped"), F.coalesce("unmapped", zero).alias("unmapped"))


def insert_mean(aln: DataFrame, most: int = 9999, largest: int = 10000) -> DataFrame:
    """aln(rid, isize): mean insert of the first reads in order with 0 < isize < largest, most of them at most; the sum
    over their number and one, whole; and five times it, the limit."""
    first = aln.filter((F.col("isize") > 0) & (F.col("isize") < largest)).select("rid", "isize").orderBy("rid").limit(most)
    mean = F.floor(F.coalesce(F.sum("isize"), F.lit(0)) / (F.count(F.lit(1)) + 1)).cast("long")
    return first.agg(mean.alias("mean")).withColumn("insert_limit", F.col("mean") * 5)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, <name>...: the value at index int(share * n + 0.499) of each group's sorted values. Counts of distinct
    values are ordered, not the rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("_through", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda s: F.least(F.floor(F.lit(s) * F.col("_all") + 0.499), F.col("_all") - 1)
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_through") > at(s), F.col(value))).alias(name) for name, s in shares.items()])


def insert_statistics(pairs: DataFrame, fold: float = 2.0) -> DataFrame:
    """pairs(orientation, isize) -> orientation, n, q1, q2, q3, low, high, mean, sd: quartiles by nearest rank, bounds at
    fold quartile distances, mean and deviation of what is within."""
    q = nearest_rank(pairs, ["orientation"], "isize", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    bounds = q.withColumn("low", F.greatest(F.lit(1), F.floor(F.col("q1") - fold * (F.col("q3") - F.col("q1")) + 0.499))).withColumn("high", F.floor(F.col("q3") + fold * (F.col("q3") - F.col("q1")) + 0.499))
    inside = pairs.join(F.broadcast(bounds), "orientation").filter(F.col("isize").between(F.col("low"), F.col("high")))
    stats = inside.groupBy("orientation").agg(F.count(F.lit(1)).alias("n"), F.avg("isize").alias("mean"), F.stddev_pop("isize").alias("sd"))
    return bounds.join(stats, "orientation").select("orientation", "n", "q1", "q2", "q3", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "mean", "sd")


def orientation(a_rev, b_rev):
    """FF, FR, RF or RR of two reads in the order of the contig."""
    return F.concat(F.when(a_rev, "R").otherwise("F"), F.when(b_rev, "R").otherwise("F"))


def insert_histogram(aln: DataFrame) -> DataFrame:
    """aln(flag, isize) of first reads -> isize, inward, outward, other."""
    f = F.col("flag")
    rows = aln.filter(has(f, "PAIRED") & none_of(f, 0x90C) & (F.col("isize") != 0) & has(f, "READ1"))
    same = has(f, "REVERSE") == has(f, "MREVERSE")
    inward = has(f, "REVERSE") == (F.col("isize") < 0)
    return rows.groupBy(F.abs("isize").alias("isize")).agg(F.count_if(~same & inward).alias("inward"), F.count_if(~same & ~inward).alias("outward"), F.count_if(same).alias("other"))


def summary_numbers(aln: DataFrame) -> DataFrame:
    """aln(flag, qlen, mapq) -> name, value: the summary section."""
    f = F.col("flag")
    p = none_of(f, 0x900)
    one = aln.agg(
        F.count_if(p).alias("sequences"), F.count_if(p & none_of(f, 4)).alias("reads_mapped"), F.count_if(p & has(f, "UNMAP")).alias("reads_unmapped"), F.count_if(p & has(f, "PAIRED")).alias("reads_paired"),
        F.count_if(p & has(f, "DUP")).alias("reads_duplicated"), F.count_if(p & has(f, "QCFAIL")).alias("reads_qc_failed"), F.count_if(p & none_of(f, 4) & (F.col("mapq") == 0)).alias("reads_mq0"),
        F.count_if(has(f, "SECONDARY")).alias("non_primary"), F.sum(F.when(p, F.col("qlen"))).cast("long").alias("total_length"), F.max(F.when(p, F.col("qlen"))).cast("long").alias("maximum_length"),
        F.sum(F.when(p & none_of(f, 4), F.col("qlen"))).cast("long").alias("bases_mapped"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in one.columns])).alias("r")).select("r.*")


def read_lengths(aln: DataFrame) -> DataFrame:
    """qlen, reads, first, last: lengths of primary records."""
    f = F.col("flag")
    return aln.filter(none_of(f, 0x900)).groupBy("qlen").agg(F.count(F.lit(1)).alias("reads"), F.count_if(has(f, "READ1")).alias("first"), F.count_if(has(f, "READ2")).alias("last"))


def cycle_qualities(aln: DataFrame) -> DataFrame:
    """aln(flag, qual) -> cycle, qual, n."""
    return aln.filter(none_of(F.col("flag"), 0x900)).select(F.posexplode("qual").alias("cycle", "qual")).groupBy("cycle", "qual").agg(F.count(F.lit(1)).alias("n"))


def cycle_bases(aln: DataFrame) -> DataFrame:
    """aln(flag, seq) -> cycle, a, c, g, t, n."""
    each = aln.filter(none_of(F.col("flag"), 0x900)).select(F.posexplode(letters(F.upper("seq"))).alias("cycle", "b"))
    return each.groupBy("cycle").agg(*[F.count_if(F.col("b") == x).alias(x.lower()) for x in "ACGTN"])


def gc_histogram(aln: DataFrame) -> DataFrame:
    """aln(seq) -> gc (per cent, rounded down), reads."""
    from strandwise.functions.sequence import gc_count

    return aln.groupBy(F.floor(gc_count(F.col("seq")) * 100 / F.greatest(F.length("seq"), F.lit(1))).cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("reads"))


def coverage_histogram(depths: DataFrame, most: int = 1000) -> DataFrame:
    """depths(depth) -> depth (most stands for all above), positions."""
    return depths.groupBy(F.least("depth", F.lit(most)).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("positions"))


def indel_histogram(aln: DataFrame) -> DataFrame:
    """aln(cigar) -> len, insertions, deletions."""
    ops = aln.select(F.explode("cigar").alias("c")).select("c.*").filter("op in ('I', 'D')")
    return ops.groupBy(F.col("len").cast("long").alias("len")).agg(F.count_if(F.col("op") == "I").alias("insertions"), F.count_if(F.col("op") == "D").alias("deletions"))


def checksums(reads: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: for each column the sum of the values' crc32 modulo 2^32, whatever their order."""
    return reads.agg(*[(F.coalesce(F.sum(F.crc32(F.col(c).cast("string").cast("binary"))), F.lit(0)) % (1 << 32)).cast("long").alias(c) for c in columns])


def fragmented_share(aln: DataFrame, least: float = 0.7) -> DataFrame:
    """aln(flag, qlen, aligned): the share of primary mapped reads that align for less than least of their length."""
    rows = aln.filter(none_of(F.col("flag"), 0x904))
    return rows.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("aligned") < least * F.col("qlen")).alias("fragmented"))
