"""Single passes with bounded state, as Structured Streaming: duplicates within a watermark, sessions, windows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def drop_duplicates_within(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, beg, end, n: runs of events with no gap between them (gaps and islands, with time as the position)."""
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("beg"), F.col("w.end").alias("end"), "n")


def windows(stream: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """beg, n, total: events and the sum of value in tumbling windows, or sliding ones."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("beg"), "n", "total")


def best_of(stream: DataFrame, keys: list[str], score: str, row: str, time: str = "ts", width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """keys, beg, row: the row of the best score of each key in each window, the smaller on ties: what a moving buffer
    of a duplicate marker keeps. State is one pair for each key and open window."""
    best = F.min(F.struct(F.negate(score).alias("s"), F.col(row).alias("r")))["r"]
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(best.alias(row))
    return grouped.select(*keys, F.col("w.start").alias("beg"), row)


def run(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs the stream over what there is into path (append: rows; complete: the last state), and reads it back."""
    spark = stream.sparkSession
    at = f"{path}/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(f"{at}/rows")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def ordered_or_fail(stream: DataFrame, column: str, path: str) -> int:
    """Runs the stream; rows that come after a later batch's began are an error. Returns the number of rows."""
    seen = {"top": None, "rows": 0}

    def check(df: DataFrame, _: int) -> None:
        low, high, n = df.agg(F.min(column), F.max(column), F.count(F.lit(1))).collect()[0]
        if n and seen["top"] is not None and low < seen["top"]:
            raise ValueError(f"{column} goes back from {seen['top']} to {low}")
        seen["top"], seen["rows"] = high if n else seen["top"], seen["rows"] + n

    stream.writeStream.option("checkpointLocation", os.path.join(path, uuid.uuid4().hex)).trigger(availableNow=True).foreachBatch(check).start().awaitTermination()
    return seen["rows"]
