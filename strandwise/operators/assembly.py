"""Assembly and read-set statistics, budgets and blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def genome_size(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.count(F.lit(1)).alias("contigs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total"))


def running_totals(counts: DataFrame, key: str, totals: dict[str, str], descending: bool = True) -> DataFrame:
    """counts(key, values), keys distinct -> with the running sum of each value (totals: value -> its column's name) in
    the order of the keys, and the sum of all as all_<name>.

    Distinct keys are few next to rows; still no single task sees them all: sums of key ranges are added up first, and
    each range's rows then start from the sum of those before. Ranges are powers of two of the key's size."""
    k = F.col(key)
    wide = counts.withColumn("_range", F.when(k <= 0, F.lit(0)).otherwise(F.floor(F.log2(k.cast("double")) * 64).cast("int")))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sums = wide.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in totals])  # 64 ranges for each doubling
    past = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{v}").over(past), F.lit(0)).alias(f"_before_{v}") for v in totals], *[F.sum(f"_sum_{v}").over(Window.partitionBy()).alias(f"all_{t}") for v, t in totals.items()])
    own = Window.partitionBy("_range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    run = wide.select("*", *[F.sum(v).over(own).alias(f"_own_{v}") for v in totals]).join(F.broadcast(starts), "_range")
    return run.select(*counts.columns, *[(F.col(f"_own_{v}") + F.col(f"_before_{v}")).alias(t) for v, t in totals.items()], *[f"all_{t}" for t in totals.values()])


def running_total(counts: DataFrame, key: str, value: str, total: str, descending: bool = True) -> DataFrame:
    return running_totals(counts, key, {value: total}, descending).drop(f"all_{total}")


def n_stats(contigs: DataFrame) -> DataFrame:
    """contigs(len) -> k, length, rank for k = 10 ... 90: the first length, from the longest, whose running sum reaches
    k per cent of the total. Equal lengths are one row, so what is ordered is small; both sums come from one pass."""
    counts = contigs.filter("len > 0").groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))
    reach = running_totals(counts, "len", {"bases": "through", "n": "rows"})
    ks = F.explode(F.array(*[F.lit(k) for k in range(1, 10)])).alias("k")
    each = reach.select("*", ks).withColumn("need", F.col("all_through") * F.col("k") / 10)
    best = each.filter(F.col("through") >= F.col("need")).groupBy("k", "need").agg(F.max(F.struct("len", "rows", "n", "through")).alias("b"))
    rank = F.col("b.rows") - F.col("b.n") + F.greatest(F.lit(1), F.ceil((F.col("need") - (F.col("b.through") - F.col("b.len") * F.col("b.n"))) / F.col("b.len")))
    return best.select((F.col("k") * 10).cast("int").alias("k"), F.col("b.len").alias("length"), rank.cast("long").alias("rank"))


def assembly_summary(contigs: DataFrame) -> DataFrame:
    return contigs.agg(
        F.count(F.lit(1)).alias("contigs"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total"), F.floor(F.avg("len")).cast("long").alias("mean")
    )


def length_histogram(reads: DataFrame, width: int = 1000) -> DataFrame:
    """reads(len) -> bin, reads, bases, bases_from: bases in reads of this bin and longer ones."""
    bins = reads.groupBy(F.floor(F.col("len") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"))
    return running_total(bins, "bin", "bases", "bases_from").select("bin", "reads", "bases", F.col("bases_from").cast("long").alias("bases_from"))


def length_cutoff(reads: DataFrame, genome: int, depth: float) -> int:
    """The least read length so that reads from it on give that depth of the genome; 0 if all don't. One row comes to
    the driver."""
    counts = reads.groupBy("len").agg(F.sum("len").alias("bases"))
    row = running_total(counts, "len", "bases", "through").filter(F.col("through") >= genome * depth).agg(F.max("len")).collect()[0][0]
    return int(row or 0)


def keyed_running_total(df: DataFrame, order: str, value: str, total: str, width: int = 1 << 16) -> DataFrame:
    """The running sum of value by a unique numeric order column: sums of ranges of it first, then rows within each."""
    wide = df.withColumn("_range", F.floor(F.col(order) / width))
    sums = wide.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # Ranges of ranges keep the ordered windows short on any input.
    outer = sums.withColumn("_outer", F.floor(F.col("_range") / width))
    tops = outer.groupBy("_outer").agg(F.sum("_sum").alias("_s"))
    tops = tops.select("_outer", F.coalesce(F.sum("_s").over(Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b1"))
    within = F.coalesce(F.sum("_sum").over(Window.partitionBy("_outer").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = outer.withColumn("_b2", within).join(tops, "_outer").select("_range", (F.col("_b1") + F.col("_b2")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return wide.withColumn("_own", own).join(starts, "_range").withColumn(total, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def block_plan(contigs: DataFrame, blocks: int) -> DataFrame:
    """contigs(tid, len) -> tid, len, block: contigs in order, dealt to blocks by the running sum of their lengths; a
    block holds total / blocks + 1 bases, so there are at most that many."""
    total = contigs.agg(F.sum("len").alias("_t"))
    size = F.floor(F.col("_t") / blocks) + 1
    run = keyed_running_total(contigs.select("tid", "len"), "tid", "len", "_run")
    return run.join(F.broadcast(total)).select("tid", "len", F.floor((F.col("_run") - F.col("len")) / size).cast("long").alias("block"))


def greedy_blocks(contigs: DataFrame, blocks: int) -> DataFrame:
    """The greedy plan: a block is closed once its own lengths reach total / blocks + 1. The list of contigs is scanned
    in order in one task; it has (tid, len) alone."""
    total = contigs.agg(F.coalesce(F.sum("len"), F.lit(0))).collect()[0][0]
    limit = total // blocks + 1

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        block = have = 0
        out = []
        for tid, n in zip(*(pdf.sort_values("tid")[c] for c in ("tid", "len"))):
            out.append((tid, n, block))
            have += n
            if have >= limit:
                block, have = block + 1, 0
        return pd.DataFrame(out, columns=["tid", "len", "block"])

    return contigs.select("tid", "len", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(plan, "tid bigint, len bigint, block bigint")


def within_budget(reads: DataFrame, budget: int, order: str = "rid", length: str = "len") -> DataFrame:
    """Reads in order until their bases reach the budget; the read that reaches it is the last."""
    run = keyed_running_total(reads, order, length, "_run")
    return run.filter(F.col("_run") - F.col(length) < budget).drop("_run")


def read_filter(reads: DataFrame, shortest: int = 0, longest: int = 1 << 40, n_below: int = 300) -> DataFrame:
    """reads(rid, seq[, mate_seq]): lengths in range by the first read; a pair with an N where both are short goes."""
    n = F.length("seq")
    keep = n.between(shortest, longest)
    if "mate_seq" in reads.columns:
        m = F.length("mate_seq")
        bad = (F.contains(F.upper("seq"), F.lit("N")) | F.contains(F.upper("mate_seq"), F.lit("N"))) & (n < n_below) & (m < n_below)
        keep = keep & m.between(shortest, longest) & ~bad
    return reads.filter(keep)


def balanced_parts(reads: DataFrame, parts: int) -> DataFrame:
    """reads(rid, ...) with part: read pairs dealt round to the parts by their number."""
    return reads.withColumn("part", F.pmod(F.floor(F.col("rid") / 2), F.lit(parts)))


def unfinished(members: DataFrame, finished: DataFrame, on: str = "contig") -> DataFrame:
    """Members that aren't finished; the last finished one is redone (it may be incomplete)."""
    last = finished.agg(F.max("order").alias("order"))
    done = finished.join(F.broadcast(last), "order", "left_anti")
    return members.join(done.select(on), on, "left_anti")
