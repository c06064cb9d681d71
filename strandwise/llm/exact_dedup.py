"""Exact de-duplication by skew-safe combining; DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space became one space. Rows are first
combined within their own partition (the partial aggregate), then within salted digest groups (the exchange on
digest, salt and text), and the winners of the salts are combined once more. Every stage groups on the whole text
next to its digest, so two texts that only share a digest never merge.

Salted are the digests that repeat and hold at least HOT_SHARE of all rows: there are fewer than 1 / HOT_SHARE of those,
so their list has a proven size bound and may be broadcast. All other texts cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import boxed, materialise

#: A digest is hot when it holds at least this share of the rows, and HOT_ROWS rows: of fewer than 4,096 rows, all that
#: repeat.
HOT_SHARE, HOT_ROWS = 1 / 2048, 2
SALTS = 32


def fold_spaces(text: Column) -> Column:
    """Each run of ASCII white space becomes one space. Lone spaces, by far the most, aren't matched at all."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, digest=sha256, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so all empty texts are one group. The smallest doc_id stays; null ids come last, and
    of rows that repeat an id one is kept. Other columns are ignored. An empty table gives an empty result.
    digest: what groups are found by; any function will do, as the texts themselves are compared as well.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), fold_spaces(F.col("text")).alias("t")).withColumn("h", digest(F.col("t")))
    true_digest = rows if digest is sha256 else rows.withColumn("sha", sha256(F.col("t")))
    # Rows that repeat an id and a digest are one row with their number, as they differ in nothing that is returned.
    keys = ["doc_id", "h"] if digest is sha256 else ["doc_id", "h", "sha"]
    ids = materialise(true_digest.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), "exact-ids")
    least = max(hot_rows, int((ids.agg(F.sum("times")).collect()[0][0] or 0) * hot_share))
    hot = ids.groupBy("h").agg(F.sum("times").alias("n")).filter(F.col("n") >= least).select("h", F.lit(True).alias("hot"))
    hot = materialise(hot, "exact-hot")  # fewer than 1 / hot_share rows

    salted = (
        rows.join(F.broadcast(hot), "h", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)))
        .groupBy("h", "hot", "salt", "t")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    # Texts of hot groups go on to the last stage; the others are done, and only their counts are kept.
    salted = materialise(salted.select("h", "hot", "keep_id", "n", F.when(F.col("hot"), F.col("t")).alias("t")), "exact-salted")
    warm = salted.filter(~F.col("hot")).select("h", "keep_id", F.col("n").alias("group_size"))
    most = salted.filter("hot").groupBy("h", "t").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).select("h", "keep_id", "group_size")
    most = materialise(most, "exact-most")

    # Digests that several texts share: none with SHA-256, but then the members must be told apart by their text.
    shared = warm.unionByName(most).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = materialise(shared, "exact-shared")
    if digest is sha256:
        most = F.broadcast(most)  # as many rows as hot digests; another digest may have any number of texts for each
    found = [
        ids.join(F.broadcast(hot), "h", "left_anti").join(warm, "h"),
        ids.join(F.broadcast(hot), "h", "left_semi").join(most, "h"),
    ]
    if not shared.isEmpty():
        members = true_digest.join(shared, "h", "left_semi").groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("times"))
        groups = members.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
        found = [f.join(shared, "h", "left_anti") for f in found] + [members.join(groups, ["h", "t"]).drop("t")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # Of rows that repeat the id that stays, the first stays.
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    digests = F.col("h" if digest is sha256 else "sha").alias("text_sha256")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), digests)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the same columns. Of rows that repeat an id and a text, one stays."""
    key = lambda digest: F.concat_ws(":", F.col("doc_id").cast("string"), digest)
    keep = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("key"))
    keyed = boxed(docs, key(sha256(fold_spaces(F.col("text")))).alias("key"))
    return keyed.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
