"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each document is repeated k times, k drawn from a Poisson distribution whose mean is the repetition rate of its
source. The draw inverts the distribution at a uniform number hashed from seed and id, so that it is the same in any
run, on any partitioning. Where the rate is over WHOLE, the probabilities would underflow: such a draw is the sum of
independent draws, each of an equal part of the rate, at most PART, with a uniform number of its own. The copies are
dealt to random partitions and put in random order there: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import boxed

#: A source's target weight is its share of all characters to this power; 1 keeps the shares, 0 makes sources equal.
TEMPERATURE = 0.5
#: Characters of the mix for each character of the input.
EPOCHS = 1.0
SEED = 17
#: The rates are broadcast up to so many sources (about 1 KB each); with more they are joined by a shuffle.
MAX_BROADCAST = 20_000
#: Rates up to WHOLE are drawn at once, as exp(-rate) is a plain double; higher ones in parts of at most PART.
WHOLE, PART = 600.0, 500.0
#: Copies that one array of numbers holds.
BLOCK = 1 << 16


def uniform(*parts: Column) -> Column:
    """From 0 up to 1, in steps of 2^-52, by MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """source, rate: the mean number of copies of each of its documents. weights: by source, any scale; others get 0.

    Null sources are one source, ''. Sources without characters get rate 0.
    """
    per = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        per = per.withColumn("w", F.pow("chars", F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        per = per.withColumn("w", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)))
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    rate = F.when((F.col("chars") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_chars") * F.lit(float(epochs)) / F.col("chars")).otherwise(F.lit(0.0))
    return per.join(F.broadcast(total)).select("source", rate.alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(k <= 0), P(k <= 1), ... until what is left is below the uniform number's step."""
    last = F.ceil(rate + F.lit(9.0) * F.sqrt(rate) + F.lit(18.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED, numbered: bool = True) -> DataFrame:
    """The columns of docs(doc_id, text, source, ...), and copy (0, 1, ... of that document) and shuffle_key; numbered:
    with these two, which stand in for columns of docs that have their names. Otherwise docs' columns alone, all of them.

    Rows come dealt by shuffle_key and sorted by it within each partition. Rows that repeat an id are drawn alike.
    A rate may be any: the work for a document is in proportion to its copies. An empty table gives an empty result.
    """
    rate = rates(docs, weights, temperature, epochs)
    parts = F.when(F.col("rate") > WHOLE, F.ceil(F.col("rate") / PART)).otherwise(F.lit(1)).cast("int")
    rate = rate.select("source", parts.alias("parts"), (F.col("rate") / parts).alias("rate")).select("source", "parts", _cdf(F.col("rate")).alias("cdf"))
    if rate.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        rate = F.broadcast(rate)
    rows = boxed(docs, F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("id"), uniform(F.lit(seed), F.col("doc_id")).alias("u"), without=("copy", "shuffle_key") if numbered else ())
    draw = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, k: n + draw(uniform(F.lit(seed), F.col("id"), k)))
    n = F.when(F.col("parts") == 1, draw(F.col("u"))).otherwise(more)
    drawn = rows.join(rate, "source").withColumn("n", n).filter("n > 0")
    blocks = drawn.select("row", "id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("block"))
    first = F.col("block") * BLOCK
    copies = blocks.select("row", "id", F.explode(F.sequence(first, F.least(first + F.lit(BLOCK), F.col("n")) - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy")).cast("binary"))
    dealt = copies.select("row", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", "copy", "shuffle_key") if numbered else dealt.select("row.*")
