"""Split reads: gaps between their pieces, clusters of such gaps, points to cut an assembly at, robust depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.ranges import overlap_join
from strandwise.operators.regions import merge_intervals


def split_gaps(parts: DataFrame, clip: float = 0.1, longest: int = 30000) -> DataFrame:
    """parts(qname, tid, strand, qbeg, qend, qlen, beg, end): the pieces of split reads -> qname, tid, strand, beg, end,
    ref_gap, read_gap, label: what lies between one piece and the next of the same read, contig and strand.

    Both pieces go the same way, at most the share clip of the read lies outside them at each end, and both distances are
    below longest. label is the reference's distance less the read's: above 0 where the contig has bases too many.
    A window holds the pieces of one read, which are few.
    """
    w = Window.partitionBy("qname", "tid", "strand").orderBy("qbeg", "beg", "end", "qend")
    last = {c: F.lag(c).over(w) for c in ("qbeg", "qend", "beg", "end")}
    pairs = parts.select("*", *[x.alias(f"_{c}") for c, x in last.items()]).filter("_qbeg is not null and beg >= _beg and end >= _end")
    gaps = pairs.withColumn("ref_gap", F.col("beg") - F.col("_end")).withColumn("read_gap", F.col("qbeg") - F.col("_qend"))
    outside = (F.col("_qbeg") < F.col("qlen") * clip) & (F.col("qlen") - F.col("qend") < F.col("qlen") * clip)
    near = (F.abs("ref_gap") < longest) & (F.abs("read_gap") < longest)
    rows = gaps.filter(outside & near)
    return rows.select("qname", "tid", "strand", F.least("_end", "beg").alias("beg"), F.greatest("_end", "beg").alias("end"), "ref_gap", "read_gap", (F.col("ref_gap") - F.col("read_gap")).alias("label"))


def gap_clusters(gaps: DataFrame, near: int = 0) -> DataFrame:
    """split_gaps' rows -> tid, beg, end, n, valid, typical: gaps that overlap (or lie within near of each other), how
    many have a label above 0, and the label with most others within a tenth of its size, rounded down to 10, 20, 40, 80 or
    100 (at least 10), the lower on ties.

    Labels are counted before they are compared, so a cluster's window has its different labels only.
    """
    clusters = merge_intervals(gaps, "tid", near)
    points = gaps.select("tid", "beg", "end", "label")
    inside = overlap_join(clusters.select("tid", "beg", "end", "n"), points).filter("r_beg >= beg and r_end <= end")
    counts = inside.groupBy("tid", "beg", "end", "n", F.col("r_label").alias("label")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("tid", "beg", "end").orderBy("label")
    # A window's bound can't follow the row, so the reach is rounded down to one of a few steps.
    around = {step: F.sum("_k").over(w.rangeBetween(-step, step)) for step in (10, 20, 40, 80, 100)}
    reach = F.least(F.greatest(F.floor(F.abs("label") / 10), F.lit(10)), F.lit(100))
    near_by = F.coalesce(*[F.when(reach >= step, around[step]) for step in (100, 80, 40, 20, 10)])
    scored = counts.withColumn("_near", near_by)
    return scored.groupBy("tid", "beg", "end", "n").agg(F.coalesce(F.sum(F.when(F.col("label") > 0, F.col("_k"))), F.lit(0)).cast("long").alias("valid"), F.min_by("label", F.struct(-F.col("_near"), F.col("label"))).alias("typical"))


def supported_clusters(clusters: DataFrame, depth: DataFrame, share: float = 0.2, low: float = 0.5) -> DataFrame:
    """clusters(tid, beg, end, n), depth(tid, pos, depth) -> the clusters whose count is above the share of the depth
    inside, where that depth is below low times the contig's median. The median is over counted depths."""
    medians = weighted_rank(depth.groupBy("tid", "depth").agg(F.count(F.lit(1)).alias("_w")), "tid", "depth", "_w")
    points = depth.select("tid", F.col("pos").alias("beg"), (F.col("pos") + 1).alias("end"), "depth")
    local = overlap_join(clusters, points).groupBy(*clusters.columns).agg(F.avg("r_depth").alias("local"))
    return local.join(medians, "tid").filter((F.col("n") > share * F.col("local")) & (F.col("local") < low * F.col("median"))).select(*clusters.columns, "local")


def weighted_rank(counts: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """counts(key, value, weight) -> key, median: the value at rank n // 2, from 0, of the values repeated by weight."""
    w = Window.partitionBy(key).orderBy(value)
    run = counts.withColumn("_run", F.sum(weight).over(w)).withColumn("_n", F.sum(weight).over(Window.partitionBy(key)))
    return run.filter(F.col("_run") > F.floor(F.col("_n") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def clipped_mean(depths: DataFrame, key: str = "tid", value: str = "depth", start: int = 150, rounds: int = 40) -> DataFrame:
    """depths(key, value) -> key, mean: the whole mean of positive values below three times the mean before, from start,
    until it stops growing, for at most that many rounds.

    The rounds work on one array of (value, count) for each key, with as many entries as there are different depths.
    """
    counts = depths.filter(F.col(value) > 0).groupBy(key, F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    lists = counts.groupBy(key).agg(F.collect_list(F.struct("v", "c")).alias("_l"))

    def step(s: Column) -> Column:
        below = F.filter("_l", lambda x: x["v"] < s["mean"] * 3)
        n, t = (F.aggregate(below, F.lit(0).cast("long"), f) for f in (lambda a, x: a + x["c"], lambda a, x: a + x["v"] * x["c"]))
        mean = F.when(n > 0, F.floor(t / n)).otherwise(0).cast("long")
        return F.when(s["go"], F.struct(mean.alias("mean"), (mean > s["mean"]).alias("go"))).otherwise(s)

    first = F.struct(F.lit(start).cast("long").alias("mean"), F.lit(True).alias("go"))
    return lists.select(key, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, _: step(s))["mean"].alias("mean"))


def window_width(aln: DataFrame, parts: int = 20, least: int = 500) -> DataFrame:
    """aln(tid, beg, end) -> tid, width: a part of the median read span, at least least."""
    counts = aln.groupBy("tid", (F.col("end") - F.col("beg")).alias("_s")).agg(F.count(F.lit(1)).alias("_w"))
    return weighted_rank(counts, "tid", "_s", "_w").select("tid", F.greatest(F.floor((F.col("median") + 1) / parts), F.lit(least)).cast("long").alias("width"))


def split_points(low: DataFrame, clusters: DataFrame, sites: DataFrame) -> DataFrame:
    """low(tid, beg, end): runs of low depth, clusters(tid, beg, end), sites(tid, pos, qv) -> tid, beg, end, point: runs
    that no cluster bridges, and the site of best quality inside (the first on ties)."""
    alone = overlap_join(low.select("tid", "beg", "end"), clusters.select("tid", "beg", "end"), how="left_anti")
    points = sites.select("tid", F.col("pos").alias("beg"), (F.col("pos") + 1).alias("end"), "qv")
    return overlap_join(alone, points).groupBy("tid", "beg", "end").agg(F.min_by("r_beg", F.struct(-F.col("r_qv"), F.col("r_beg"))).alias("point"))


def cut_contigs(contigs: DataFrame, points: DataFrame) -> DataFrame:
    """contigs(tid, contig, seq), points(tid, point) -> tid, contig, seq: the pieces; those of a cut contig are named with
    _s and their number."""
    at = points.groupBy("tid").agg(F.array_sort(F.collect_set(F.col("point").cast("int"))).alias("_p"))
    rows = contigs.join(at, "tid", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<int>")))
    bounds = F.concat(F.array(F.lit(0)), F.filter("_p", lambda x: (x > 0) & (x < F.length("seq"))), F.array(F.length("seq")))
    each = rows.withColumn("_b", bounds).select("tid", "contig", "seq", "_b", F.posexplode(F.slice("_b", 1, F.size("_b") - 1)).alias("_i", "_beg"))
    name = F.when(F.size("_b") > 2, F.concat("contig", F.lit("_s"), F.col("_i").cast("string"))).otherwise(F.col("contig"))
    return each.select("tid", name.alias("contig"), F.substring("seq", F.col("_beg") + 1, F.element_at("_b", F.col("_i") + 2) - F.col("_beg")).alias("seq"))
