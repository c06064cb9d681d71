"""Near-duplicates by SimHash, found with a Gray-order hierarchical index.

Fingerprints: of each text's 4-word shingles (XXH64, seed 42) a bit is set where over half the hashes have it.

Links: two fingerprints that differ in at most RADIUS of 64 bits agree on all but RADIUS of any number of bit blocks.
The index has a tree for each choice of blocks. Its top nodes are the masked bit patterns of the chosen blocks: one
node for each pattern, dealt out by a shuffle. Within a node fingerprints are sorted by their Gray rank, so that
neighbours differ in few bits; runs of them are leaves, and above these each node holds the bits that all its members
share. A search compares two nodes by their shared bits, drops the pair as a whole once the accumulated differences
exceed the radius, and goes down otherwise; members that one chain of links already joins aren't compared again, so a
dense group costs no more than a chain through it. A top node with more members than SPLIT is dealt again over choices
of sub-blocks of its other bits, which loses no link, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import boxed, materialise, small_batches
from strandwise.llm.components import components
from strandwise.llm.exact_dedup import sha256

SEED, SHINGLE, RADIUS = 42, 4, 4
LEAF = 32
SPLIT = 200_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text; 0 where there are no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    plain = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(sizes)
    first = end - sizes
    hash64 = xxhash.xxh64_intdigest
    h = np.array([hash64(plain[a:b], SEED) for a, b in zip(first[:n].tolist(), (end[-n:] - 1).tolist())], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a signed long), with digest also the text's; other columns are
    dropped."""
    small_batches(docs.sparkSession)

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            more = [b.column("digest")] if digest else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), *more], names=["doc_id", "fp", "digest"][: 2 + digest])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([_digest().alias("digest")] if digest else [])]
    return docs.select(*cols).mapInArrow(each, "doc_id bigint, fp bigint" + (", digest string" if digest else ""))


def _digest() -> Column:
    """Of the whole text; a null text is empty, as in its fingerprint."""
    return sha256(F.coalesce(F.col("text").cast("string"), F.lit("")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each word stands in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def blocks_for(n: int) -> int:
    """Blocks that the 64 bits are cut into for n fingerprints: the fewer, the fewer choices (of all but RADIUS); the
    more, the longer the patterns, which are at least as long as n asks for."""
    need = np.log2(max(2, n)) - 3
    return next((b for b in range(RADIUS + 2, RADIUS + 7) if 64 * (b - RADIUS) / b >= need), RADIUS + 6)


def masks(bits: list[int], blocks: int, radius: int = RADIUS) -> list[int]:
    """All choices of blocks - radius of the blocks that the bits are cut into, as masks."""
    cut = [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(cut, blocks - radius)]


class _Sets:
    """Union of sets of small integers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def node_links(x: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links among the distinct words x that join whatever any links within the radius join: a spanning forest."""
    x = x[np.argsort(gray_rank(x), kind="stable")]
    n = len(x)
    sets, links = _Sets(n), []

    def compare(a0: int, a1: int, b0: int, b1: int) -> None:
        near = np.bitwise_count(x[a0:a1, None] ^ x[None, b0:b1]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1) if a0 == b0 else near)):
            if sets.join(a0 + int(i), b0 + int(j)):
                links.append((int(x[a0 + i]), int(x[b0 + j])))

    if n <= 2 * leaf:
        compare(0, n, 0, n)
        return links
    # Levels from the leaves up: of each node the bits that its members share, and their values.
    at = list(range(0, n, leaf))
    level = [(np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at))]
    while len(level[-1][0]) > 1:
        low, high = level[-1]
        two = list(range(0, len(low), 2))
        level.append((np.bitwise_and.reduceat(low, two), np.bitwise_or.reduceat(high, two)))
    for k in range(len(at)):
        compare(at[k], min(at[k] + leaf, n), at[k], min(at[k] + leaf, n))

    def apart(d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differences that all pairs of members of two nodes have: ones shared on one side, zeros on the other."""
        low, high = level[d]
        return np.bitwise_count((low[a] & ~high[b]) | (low[b] & ~high[a]))

    pairs = (np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    stack = [(len(level) - 1, *pairs)]
    while stack:
        d, a, b = stack.pop()
        if d == 0:
            for i, j in zip(a.tolist(), b.tolist()):
                if i != j:
                    a0, a1, b0, b1 = at[i], min(at[i] + leaf, n), at[j], min(at[j] + leaf, n)
                    root = sets.find(a0)
                    if all(sets.find(k) == root for k in (a1 - 1, b0, b1 - 1)) and all(sets.find(k) == root for k in (*range(a0, a1), *range(b0, b1))):
                        continue
                    compare(a0, a1, b0, b1)
            continue
        low = len(level[d - 1][0])
        a2 = np.concatenate((2 * a, 2 * a, 2 * a + 1, 2 * a + 1))
        b2 = np.concatenate((2 * b, 2 * b + 1, 2 * b, 2 * b + 1))
        fine = (a2 < low) & (b2 < low) & (a2 <= b2)
        a2, b2 = a2[fine], b2[fine]
        near = apart(d - 1, a2, b2) <= radius
        a2, b2 = a2[near], b2[near]
        for i in range(0, len(a2), 1 << 15):  # depth first: what waits stays small
            stack.append((d - 1, a2[i : i + (1 << 15)], b2[i : i + (1 << 15)]))
    return links


def links(distinct: DataFrame, n: int, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """distinct(fp) -> a, b: links that join whatever links within the radius join."""
    spark = distinct.sparkSession
    small_batches(spark, 1 << 16)
    choices = masks(list(range(64)), blocks_for(n))
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]

    def within(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            t, key, fp = cols
            edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True])))
            found: list[tuple[int, int]] = []
            length = np.diff(edge)
            two = edge[:-1][length == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            found += zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist())
            for a, k in zip(edge[:-1][length > 2].tolist(), length[length > 2].tolist()):
                found += node_links(fp[a : a + k], radius)
            if found:
                ab = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for b in frames:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols[2] = cols[2].view(np.uint64)
            wait.append(tuple(cols))
            size += len(cols[0])
            if size >= 1 << 18:
                cols = [np.concatenate(c) for c in zip(*wait)]
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                cut = int(np.argmax(last))  # the last group may go on
                if cut:
                    yield from out([c[:cut] for c in cols])
                wait, size = [tuple(c[cut:] for c in cols)], size - cut
        if wait:
            yield from out([np.concatenate(c) for c in zip(*wait)])

    nodes = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"), "fp")
    hot = nodes.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split).select("t", "key")
    # A top node of over split members needs n > split: below that there is none to look for.
    if n > split and not (hot := materialise(hot, "simhash-hot")).isEmpty():
        fine = []
        for t, m in enumerate(choices):
            rest = masks([b for b in range(64) if not m >> b & 1], 8)
            fine.append(F.array(*[F.lit((m | r) - (1 << 64) if (m | r) >> 63 else (m | r)) for r in rest]))
        more = nodes.join(hot, ["t", "key"], "left_semi")
        more = more.select("t", "fp", F.posexplode(F.element_at(F.array(*fine), F.col("t") + 1)).alias("s", "m"))
        more = more.select((F.lit(len(choices)) + F.col("t") * 1000 + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
        nodes = nodes.join(hot, ["t", "key"], "left_anti").select("t", "key", "fp").unionByName(more)
    dealt = nodes.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(within, "a bigint, b bigint").distinct()


def _linked(prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """prints(fp, ...) -> fp, least (that aggregate of the fingerprint's rows), component; a row for each fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(least.alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp"), distinct.count(), radius))
    # Fingerprints without a link are their own component.
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    that links reach). Null texts count as empty: fingerprint zero. Rows with a null id link like others, but name no
    component that has another id. An empty table gives an empty result; other columns are ignored."""
    prints = materialise(fingerprints(docs), "simhash-prints")
    least = _linked(prints, F.min("doc_id"), radius)
    best = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.select("fp", "component").join(best, "component").select("fp", "component_id")
    # Few fingerprints are far more frequent than the rest: the join's skewed partitions are split at run time.
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component of fingerprints one row stays: the smallest id's, null ids last, and of rows that repeat an id
    the one whose text has the smallest digest; the same columns."""
    prints = materialise(fingerprints(docs, digest=True), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    best = _linked(prints, first, radius).groupBy("component").agg(F.min("least").alias("least"))
    # A text has one fingerprint, so an id and a digest are in one component only. A null id leaves the digest alone.
    key = lambda doc_id, digest: F.concat_ws(":", doc_id.cast("long").cast("string"), digest).alias("key")
    keyed = boxed(docs, key(F.col("doc_id"), _digest()))
    stay = best.select(key(F.col("least.doc_id"), F.col("least.digest")))
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
