"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the set of its words, pairs, triples and pairs with a gap of one or two, hashed to 2^BITS
places. Each coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero; the others are
a few thousand numbers that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandwise.llm.common import boxed, fold, small_batches
from strandwise.llm.words import batches, hashed, mix

BITS = 20
ALPHA, BETA, L2 = 1.0, 1.0, 1.0
#: The L1 term for MAX_LABELLED rows; for fewer it falls with their square root, to 1 at least.
L1 = 8.0
EPOCHS = 5
#: Parts of the labelled rows; the odds that calibrate the model come from models that didn't see the row's part.
PARTS = 4
#: The calibration's slope is this at least.
LEAST_SLOPE = 1e-3
#: The score of every text where there is nothing to learn from: no labels, or one label only.
NEUTRAL = 0.25
#: Labelled rows that the model is fitted on at most; they are chosen by a hash of their id.
MAX_LABELLED = 10_000
#: Word offsets of each kind of feature.
KINDS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def clean(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: places, and the index of the text of each."""
    h, begin, *_ = hashed(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    for k, kind in enumerate(KINDS):
        n = len(h) - kind[-1]
        if n <= 0:
            continue
        x = np.full(n, (k + 1) * 0x632BE59BD9B4E019 % (1 << 64), dtype=np.uint64)
        for j, offset in enumerate(kind):
            x += h[offset : offset + n] * np.uint64(_FACTORS[j])
        within = owner[:n] == owner[kind[-1] :] if kind[-1] else slice(None)
        yield (mix(x) >> np.uint64(64 - bits)).astype(np.int32)[within], owner[:n][within]


def feature_sets(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """The distinct places of each text, in order."""
    parts = [(p, np.searchsorted(o, np.arange(len(texts) + 1))) for p, o in features(texts, bits)]
    none = np.zeros(0, dtype=np.int32)
    return [np.unique(np.concatenate([none, *(p[cut[k] : cut[k + 1]] for p, cut in parts)])) for k in range(len(texts))]


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 5, l1: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights, and the intercept."""
    size = (1 << bits) + 1  # the last is the intercept
    z, n = np.zeros(size), np.zeros(size)
    strength = max(1.0, L1 * min(1.0, len(rows) / MAX_LABELLED) ** 0.5) if l1 is None else l1

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size - 1, 0.0, strength)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in draw.permutation(len(rows)):
            places, label = rows[r]
            i = np.append(places, size - 1)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    every = weight(np.arange(size))
    used = np.flatnonzero(every[:-1])
    return used.astype(np.int32), every[used].astype(np.float32), float(every[-1])


def calibrate(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn odds of unseen rows into log odds: a logistic fit by damped Newton steps with a
    small ridge. The slope is LEAST_SLOPE at least, so that higher odds never score lower; where that holds it up, the
    intercept is fitted to it."""

    def fitted(x: np.ndarray, plus: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
        def loss(w: np.ndarray) -> float:
            return float(np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ w + plus)).sum() + ridge @ (w - start) ** 2 / 2)

        w = start
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w + plus, -35, 35)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, x.T @ (p - labels) + ridge * (w - start))
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        return w

    one, none, ridge, start = np.ones(len(odds)), np.zeros(len(odds)), np.array([1.0, 1e-2]), np.array([1.0, 0.0])
    slope, shift = fitted(np.column_stack([odds, one]), none, ridge, start)
    if slope < LEAST_SLOPE:
        slope, shift = LEAST_SLOPE, fitted(one[:, None], LEAST_SLOPE * odds, ridge[1:], start[1:])[0]
    return float(slope), float(shift)


def train(labelled: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on labelled(doc_id, text, toxic), a bounded sample: places, their weights and the intercept.

    PARTS + 1 tasks fit a model each, all but one without a part of the rows, whose odds calibrate the model of all
    rows. The weights, a few thousand, and an odd for each row come to the driver. Without rows of both labels there is
    nothing to tell apart: no weights, and NEUTRAL's log odds.
    """
    small_batches(labelled.sparkSession)

    def feature_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            for i, j in batches(texts):
                sets = feature_sets(texts[i:j], bits)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary()), b.column("toxic").slice(i, j - i).cast(pa.int32())], names=["doc_id", "places", "toxic"])

    def fitted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows: dict[int, list] = {}
        for b in frames:
            for leave, *r in zip(*(b.column(c).to_pylist() for c in ("leave", "doc_id", "places", "toxic"))):
                rows.setdefault(leave, []).append(r)
        for leave, own in rows.items():
            own.sort(key=lambda r: (r[0], r[1]))  # any order of arrival gives the same model
            part = [xxhash.xxh64_intdigest(str(r[0]), 3) % PARTS for r in own]
            sets = [(np.frombuffer(p, dtype=np.int32), int(y)) for _, p, y in own]
            used, weights, intercept = fit([x for x, p in zip(sets, part) if p != leave], bits)
            dense = np.zeros(1 << bits)
            dense[used] = weights
            out = [x for x, p in zip(sets, part) if p == leave]
            told = [leave, used.tobytes(), weights.tobytes(), intercept, np.array([intercept + dense[p].sum() for p, _ in out]).tobytes(), np.array([y for _, y in out], dtype=np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([told[0]], pa.int32()), *(pa.array([x]) for x in told[1:])], names=["leave", "used", "weights", "intercept", "odds", "labels"])

    rows = labelled.select("doc_id", "text", "toxic").mapInArrow(feature_rows, "doc_id bigint, places binary, toxic int")
    each = rows.withColumn("leave", F.explode(F.array(*[F.lit(k) for k in range(PARTS + 1)]))).repartition(PARTS + 1, "leave")
    models = {r["leave"]: r for r in each.mapInArrow(fitted, "leave int, used binary, weights binary, intercept double, odds binary, labels binary").collect()}
    odds = np.concatenate([np.zeros(0), *(np.frombuffer(models[k]["odds"]) for k in range(PARTS) if k in models)])
    labels = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(models[k]["labels"], np.int32) for k in range(PARTS) if k in models)])
    if len(set(labels.tolist())) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(NEUTRAL / (1 - NEUTRAL)))
    slope, shift = calibrate(odds, labels)
    m = models[PARTS]
    return np.frombuffer(m["used"], np.int32), np.frombuffer(m["weights"], np.float32) * np.float32(slope), m["intercept"] * slope + shift


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, learn_from=None) -> DataFrame:
    """doc_id, text, toxic of at most about max_labelled labelled documents, chosen by a hash of the id.

    labels that contradict count as toxic; null labels are left out. learn_from: a condition on doc_id.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, 0.97 * max_labelled / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows at most, 12 bytes each
    # Rows that repeat an id: the text of least digest stands for it, whatever the partitioning.
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return found.groupBy("doc_id").agg(least.alias("text"), F.first("toxic").alias("toxic"))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """docs with a column score (0 to 1); null and empty texts get the intercept's."""
    small_batches(docs.sparkSession)
    used, weights, intercept = model
    columns = [c for c in docs.columns if c != "score"]
    at = columns.index("text")
    docs = docs.select(*columns)

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[used] = weights
        for b in frames:
            texts = [clean(t) for t in b.column(at).to_pylist()]
            total = np.full(len(texts), intercept)
            for i, j in batches(texts):
                hits = [np.zeros(0, dtype=np.int64)]
                for places, owner in features(texts[i:j], bits):
                    hit = dense[places] != 0
                    hits.append((owner[hit].astype(np.int64) << 32) | places[hit])
                both = np.unique(np.concatenate(hits))
                total[i:j] += np.bincount(both >> 32, weights=dense[both & 0xFFFFFFFF], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*columns, "score"])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels are learnt only outside the fold held out. Null and empty
    texts get the intercept's score; without labels of both kinds all get NEUTRAL, which predicts 0."""
    out = fold("doc_id", 5)
    model = train(labelled_sample(docs, labels, max_labelled, out != 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(out == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that score below the threshold, with the same columns; learns from all labels. Where there are
    no labels of both kinds, all rows stay (for any threshold over NEUTRAL)."""
    model = train(labelled_sample(docs, labels, max_labelled))
    return score(boxed(docs, "text"), model).filter(F.col("score") < threshold).select("row.*")
