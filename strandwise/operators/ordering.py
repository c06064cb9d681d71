"""Orders of alignments, merging, collating, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.flags import has
from strandwise.functions.sequence import natural_key


def coordinate_key(tid: Column, pos: Column, flag: Column) -> list[Column]:
    """Contig, position, forward before reverse; records without a contig last."""
    return [tid.asc_nulls_last(), pos.asc_nulls_last(), has(flag, "REVERSE").cast("int").asc()]


def sort_coordinate(aln: DataFrame) -> DataFrame:
    """By coordinate; the read id breaks ties. A range partitioning and sorts within it."""
    return aln.orderBy(*coordinate_key(F.col("tid"), F.col("pos"), F.col("flag")), "rid")


def sort_name(aln: DataFrame) -> DataFrame:
    """By name in natural order, then first before second reads."""
    return aln.withColumn("_n", natural_key(F.col("qname"))).orderBy("_n", F.col("flag").bitwiseAND(0xC0), "rid").drop("_n")


def sort_tag(aln: DataFrame, tag: str) -> DataFrame:
    """By a tag's value, records without it first; coordinate breaks ties."""
    return aln.orderBy(F.col(tag).asc_nulls_first(), *coordinate_key(F.col("tid"), F.col("pos"), F.col("flag")), "rid")


def merge_sorted(*parts: DataFrame) -> DataFrame:
    """All parts in coordinate order; ties by part, then read id."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_idx", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*coordinate_key(F.col("tid"), F.col("pos"), F.col("flag")), "file_idx", "rid")


def merge_targets(*headers: DataFrame) -> DataFrame:
    """headers(name, len) in the order of files -> tid, name, len: the union, a name's first place counts. Names that
    come with two lengths are an error."""
    out = None
    for i, h in enumerate(headers):
        h = h.select("name", "len", F.lit(i).alias("file"), F.col("tid").alias("old"))
        out = h if out is None else out.unionByName(h)
    names = out.groupBy("name").agg(F.min(F.struct("file", "old")).alias("at"), F.min("len").alias("len"), F.max("len").alias("most"))
    checked = names.withColumn("len", F.when(F.col("len") == F.col("most"), F.col("len")).otherwise(F.raise_error(F.concat(F.lit("two lengths of "), "name")).cast("long")))
    return checked.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("tid"), "name", "len")


def collate(aln: DataFrame, parts: int | None = None) -> DataFrame:
    """Records of one name stand together, in no other order: a hash partitioning and sorts within it."""
    dealt = aln.repartition(parts, "qname") if parts else aln.repartition("qname")
    return dealt.sortWithinPartitions("qname", F.col("flag").bitwiseAND(0xC0), "rid")


def split_by_group(aln: DataFrame, path: str, column: str = "rg") -> None:
    """One folder for each read group; records without one are unassigned."""
    aln.withColumn(column, F.coalesce(column, F.lit("unassigned"))).write.partitionBy(column).parquet(path)


def best_per_group(df: DataFrame, keys: list[str], most: int, *order: Column | str) -> DataFrame:
    """The first rows of each group by the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")
