"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import materialise

#: Links that are joined at once within a task.
CHUNK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least one that it is joined with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, step := new[new]):
            new = step
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def local_stars(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: each task joins its own, CHUNK at a time."""

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            x, y = _stars(*(np.concatenate(c) for c in zip(*wait)))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for f in frames:
            wait.append((f.column(0).to_numpy(), f.column(1).to_numpy()))
            size += f.num_rows
            if size >= CHUNK:
                yield out()
                wait, size = [], 0
        if wait:
            yield out()

    return links.select("a", "b").mapInArrow(each, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of longs -> node, component: for each node of a link the least node that links reach.

    Each round writes its links to the shared folder. A node of any degree is no task's burden: groups only need their
    least neighbour, which partial aggregates find, and are then joined with it.
    """
    now = materialise(local_stars(links).filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        # large star: of u's neighbours the larger ones go to the least of u and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours go to the least of these
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = materialise(small.filter("a <> b").distinct(), "links")
        done = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).collect()[0]["n"]
        roots = new.select(F.col("b").alias("a")).distinct().join(new.select("a").distinct(), "a", "left_semi").isEmpty()
        now = new
        if (done is None or done == 1) and roots:
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
