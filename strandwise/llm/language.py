"""Language by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of anything else become one gap, and all n-grams of 1 to MAX_N characters are counted in
2^BITS places each. Counts are gathered from every learnt document: each task adds up its own and sends what isn't
zero; then blocks of places are added across tasks, in two levels. The matrix of log probabilities (languages x places)
is broadcast, in parts of GROUP languages: a text passes one part after the other, and keeps the best language so far
and the sum of all probabilities. So any number of languages gives whole results in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import fold, materialise, small_batches

BITS, MAX_N = 14, 3
SMOOTHING = 0.5
#: Languages of one part of the matrix, 2^BITS * MAX_N * 4 bytes for each.
GROUP = 256
#: Languages that a task counts at once, and the parts that one block of places is added up in first.
HELD, SALTS = 32, 32
#: Places that are summed together.
BLOCK = 1 << 13
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For each code point: itself, or 0 where it isn't a letter."""
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per length of n-gram its places (aligned at the last character), where each text begins (one more: the end), and
    whether it has a letter."""
    both = [f" {t.lower()} " for t in texts]
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in both], out=begin[1:])
    c = _table()[np.frombuffer("".join(both).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    has = np.add.reduceat(c != 0, begin[:-1]) > 0 if len(texts) else np.zeros(0, dtype=bool)
    keep = c != 0
    keep[1:] |= c[:-1] != 0  # one gap after a word
    keep[begin[:-1]] = True
    c = c[keep]
    begin = np.concatenate(([0], np.cumsum(keep)))[begin]
    out, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(1, MAX_N + 1):
        h = c.copy() if n == 1 else np.concatenate((h[:1], c[1:] + h[:-1] * np.uint32(0x9E3779B1)))
        h[begin[:-1]] = 0  # the gap that a text begins with: nothing of the text before
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append((x >> np.uint32(32 - BITS)).astype(np.int32) + ((n - 1) << BITS))
    return out, begin, has


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def counts(labelled: DataFrame) -> DataFrame:
    """labelled(lang, text) -> lang, block, counts: a row for each language and block of places, the last place of all
    being the number of texts. Rows come sorted by language and block within each partition."""
    places = MAX_N << BITS

    def own(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        total: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                parts = [n[i : i + BLOCK] for i in range(0, places + 1, BLOCK)]
                some = [k for k, x in enumerate(parts) if x.any()]
                at = [np.flatnonzero(parts[k]) for k in some]
                yield record([lang] * len(some), some, [salt] * len(some), [x.astype(np.int32).tobytes() for x in at], [parts[k][x].tobytes() for k, x in zip(some, at)])
            total.clear()

        for b in frames:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                if lang not in total and len(total) >= HELD:
                    yield from out()
                n = total.setdefault(lang, np.zeros(places + 1, dtype=np.int64))
                n[-1] += len(texts)
                for i, j in slices(texts):
                    for p in grams(texts[i:j])[0]:
                        n[:-1] += np.bincount(p, minlength=places)
        yield from out()

    def record(lang: list, block: list, salt: list, at: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "block", "salt", "at", "counts"])

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by language and block; the salts of one come together."""
        key, total = None, np.zeros(BLOCK, dtype=np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return record([key[0]], [key[1]], [0], [at.astype(np.int32).tobytes()], [total[at].tobytes()])

        for b in frames:
            for lang, block, _, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if key != (lang, block):
                    if key:
                        yield out()
                    key = lang, block
                    total[:] = 0
                total[np.frombuffer(at, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
        if key:
            yield out()

    schema = "lang string, block int, salt int, at binary, counts binary"
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    some = known.mapInArrow(own, schema).repartition("lang", "block", "salt").sortWithinPartitions("lang", "block").mapInArrow(add, schema)
    return some.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(add, schema).select("lang", "block", "at", "counts")


def train(labelled: DataFrame, group: int = GROUP) -> list[tuple[list[str], np.ndarray]]:
    """The model in parts of `group` languages, in order: languages, and log probabilities, a row for each with
    MAX_N * 2^BITS places and its prior at the end. No rows to learn from: no parts."""
    small_batches(labelled.sparkSession)
    places = MAX_N << BITS
    by: dict[str, np.ndarray] = {}
    for r in materialise(counts(labelled), "language-counts").toLocalIterator():
        n = by.setdefault(r["lang"], np.zeros(places + 1, dtype=np.float32))
        n[r["block"] * BLOCK + np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["counts"], dtype=np.int64)
    texts = sum(float(n[-1]) for n in by.values())
    for n in by.values():
        for k in range(MAX_N):
            part = n[k << BITS : (k + 1) << BITS].astype(np.float64) + SMOOTHING
            n[k << BITS : (k + 1) << BITS] = np.log(part / part.sum())
        n[-1] = np.log(n[-1] / texts)
    langs = sorted(by)
    return [(langs[i : i + group], np.array([by[x] for x in langs[i : i + group]])) for i in range(0, len(langs), group)]


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score: the posterior probability of the language.

    Null texts and those without a letter: `und`, score 0; so are all where nothing was learnt. Ties go to the first
    language in order. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = ["doc_id", "text", "lang_pred", "best", "odds"]
    schema = "doc_id bigint, text string, lang_pred string, best double, odds double"

    def scan(part):
        def scanned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, logp = part.value
            for b in frames:
                texts = [t or "" for t in b.column("text").to_pylist()]
                told = b.column("lang_pred").to_pylist()
                best, odds = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("best", "odds"))
                for i, j in slices(texts):
                    places, begin, has = grams(texts[i:j])
                    total = np.repeat(logp[:, -1:].astype(np.float64), j - i, axis=1)
                    for p in places:
                        for k in range(len(langs)):
                            total[k] += np.add.reduceat(logp[k][p], begin[:-1], dtype=np.float64)
                    top = total.argmax(axis=0)
                    most = total[top, np.arange(j - i)]
                    own = np.exp(total - most).sum(axis=0)  # relative to this part's best
                    before, was = best[i:j], odds[i:j]
                    new = has & (most > before)
                    high = np.maximum(most, before)
                    odds[i:j] = np.where(has, own * np.exp(most - high) + was * np.exp(before - high), 0.0)
                    best[i:j] = np.where(has, high, -np.inf)
                    for x in np.flatnonzero(new):
                        told[i + x] = langs[top[x]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(told, pa.string()), pa.array(best), pa.array(odds)], names=names)

        return scanned

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("odds"))
    for part in model:
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(part)), schema)  # GROUP languages, 50 MB at most
    return rows.select("doc_id", "lang_pred", F.when(F.col("odds") > 0, 1 / F.col("odds")).otherwise(F.lit(0.0)).alias("score"))


def language(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns outside the fold held out."""
    out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.filter(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
