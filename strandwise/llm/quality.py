"""A quality classifier by co-training of two views of a document.

The text view sees hashed words, endings and pairs. The metadata view sees source and language, and the page's length,
number of lines and length of line, in steps; it reads no letter of the text, and the text view none of these. Both are logistic models fitted by FTRL-proximal. In each round each model scores *all*
documents without a label; those that it is surest of, in the labels' proportion, join the rows that the *other* model
learns from. Last, each view's scores are calibrated on labelled rows that neither learnt from, and a logistic model of
both calibrated views gives the final score.

Bounds: MAX_LABELLED labelled rows, chosen by a hash of the id; each round adds at most GROWTH times as many
pseudo-labels for each view, the surest of all documents. So one task fits the models, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import discard, fold, materialise, small_batches
from strandwise.llm.toxicity import fit
from strandwise.llm.words import batches, hashed, mix

TEXT_BITS, META_BITS = 18, 12
MAX_LABELLED = 6_000
ROUNDS = 4
#: A round's pseudo-labels from one view: that share of the labelled rows, and only where what the view sees would make
#: the model so sure if both labels were equally frequent. A view that merely knows the frequent label tells nothing.
GROWTH, SURE = 0.2, 0.9
TEXT_L1, META_L1 = 4.0, 1.0
#: Of the labelled rows, those that calibrate the views.
CALIBRATE = 0.25
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

def text_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words, endings and pairs, and whose they are."""
    h, begin, buf, first, last = hashed(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    shift = np.uint64(64 - TEXT_BITS)
    if not len(h):
        return
    yield (mix(h * np.uint64(_FACTORS[0])) >> shift).astype(np.int32), owner
    ending = buf[last].astype(np.uint64) * np.uint64(256) + buf[np.maximum(last - 1, first)]
    yield (mix(ending + np.uint64(1 << 40)) >> shift).astype(np.int32), owner
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        yield (mix(h[:-1] * np.uint64(_FACTORS[0]) + h[1:] * np.uint64(_FACTORS[1])) >> shift).astype(np.int32)[same], owner[1:][same]


def meta_features(texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    """A row of places for each text: one for each piece of metadata."""
    import xxhash

    per = np.maximum([len(t) for t in texts], 1)
    lines = np.maximum([t.count(b"\n") + (not t.endswith(b"\n")) for t in texts], 1)
    steps = [(4 * np.log2(x)).astype(np.int64) for x in (per, lines, np.maximum(per / lines, 1))]
    out = [mix(s.astype(np.uint64) + np.uint64((k + 1) << 32)) for k, s in enumerate(steps)]
    for k, names in enumerate((sources, langs)):
        known = {n: xxhash.xxh64_intdigest(f"{k}:{n}") for n in set(names)}
        out.append(np.array([known[n] for n in names], dtype=np.uint64))
    return (np.array(out).T >> np.uint64(64 - META_BITS)).astype(np.int32)


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct text places of each text."""
    parts = [(p, np.searchsorted(o, np.arange(len(texts) + 1))) for p, o in text_features(texts)]
    none = np.zeros(0, dtype=np.int32)
    return [np.unique(np.concatenate([none, *(p[cut[k] : cut[k + 1]] for p, cut in parts)])) for k in range(len(texts))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton steps with a small ridge; columns of x are features."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class View:
    """One view's model over sets of places."""

    def __init__(self, bits: int, l1: float):
        self.bits, self.l1 = bits, l1

    def learn(self, rows: list[tuple[np.ndarray, int]]) -> None:
        used, weights, self.intercept = fit(rows, self.bits, 3, l1=self.l1)
        self.dense = np.zeros(1 << self.bits, dtype=np.float32)
        self.dense[used] = weights

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.intercept + self.dense[r].sum() for r in rows])


Pair = tuple[np.ndarray, np.ndarray]


def learn_views(labelled: list[tuple[np.ndarray, np.ndarray, int]], told: tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, int]]]) -> tuple[View, View]:
    """Both views' models from labelled (text places, metadata places, label), but for the rows that calibrate, and from
    what each was told by the other: (places, label)."""
    learn = labelled[: int(len(labelled) * (1 - CALIBRATE))]
    views = View(TEXT_BITS, TEXT_L1), View(META_BITS, META_L1)
    for v in (0, 1):
        views[v].learn([(x[v], x[2]) for x in learn] + told[v])
    return views


def combine(labelled: list[tuple[np.ndarray, np.ndarray, int]], views: tuple[View, View]) -> np.ndarray:
    """Slope and intercept of each view's calibration, then weights of both calibrated views and the intercept."""
    check = labelled[int(len(labelled) * (1 - CALIBRATE)) :]
    if not check:
        return np.array([1.0, 0.0, 1.0, 0.0, 0.5, 0.5, 0.0])
    y = np.array([x[2] for x in check], dtype=np.float64)
    odds = [views[v].odds([x[v] for x in check]) for v in (0, 1)]
    scale = [_logistic(o[:, None], y) for o in odds]
    both = _logistic(np.column_stack([w[0] * o + w[1] for o, w in zip(odds, scale)]), y)
    return np.concatenate([*scale, both])


def prior(labelled: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """Log odds of label 1."""
    good = sum(x[2] for x in labelled)
    return float(np.log((good + 0.5) / (len(labelled) - good + 0.5)))


def quotas(labelled: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[int, int]:
    """How many pseudo-labels 0 and 1 a view gives in a round."""
    good = float(np.mean([x[2] for x in labelled])) if labelled else 0.5
    return tuple(int(np.ceil(GROWTH * len(labelled) * many)) for many in (1 - good, good))


def co_train(labelled: list[tuple[np.ndarray, np.ndarray, int]], pool: list[Pair], rounds: int = ROUNDS) -> tuple[View, View, np.ndarray]:
    """The same as train, over rows in memory: the views' models, and their combination."""
    told: tuple[list, list] = ([], [])
    left = list(range(len(pool)))
    views = learn_views(labelled, told)
    for _ in range(rounds):
        taken: set[int] = set()
        for v in (0, 1):
            odds = views[v].odds([pool[i][v] for i in left]) - prior(labelled)
            for label, many in enumerate(quotas(labelled)):
                sure = _sigmoid(odds if label else -odds)
                for j in np.argsort(-sure, kind="stable")[:many]:
                    if sure[j] >= SURE:
                        told[1 - v].append((pool[left[j]][1 - v], label))
                        taken.add(left[j])
        left = [i for i in left if i not in taken]
        views = learn_views(labelled, told)
    return *views, combine(labelled, views)


def _clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _odds(texts: list[bytes], source: list[str | None], lang: list[str | None], dense: list[np.ndarray], intercepts: tuple[float, float]) -> np.ndarray:
    """Both views' log odds of each text."""
    odds = np.zeros((2, len(texts)))
    odds[0], odds[1] = intercepts
    for i, j in batches(texts):
        hits = [np.zeros(0, dtype=np.int64)]
        for places, owner in text_features(texts[i:j]):
            hit = dense[0][places] != 0
            hits.append((owner[hit].astype(np.int64) << 32) | places[hit])
        both = np.unique(np.concatenate(hits))
        odds[0, i:j] += np.bincount(both >> 32, weights=dense[0][both & 0xFFFFFFFF], minlength=j - i)
        odds[1, i:j] += dense[1][meta_features(texts[i:j], source[i:j], lang[i:j])].sum(axis=1)
    return odds


def _dense(model: dict) -> list[np.ndarray]:
    out = []
    for v, bits in (("t", TEXT_BITS), ("m", META_BITS)):
        w = np.zeros(1 << bits, dtype=np.float32)
        w[np.frombuffer(model[f"{v}_used"], dtype=np.int32)] = np.frombuffer(model[f"{v}_weights"], dtype=np.float32)
        out.append(w)
    return out


def _featured(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, source, lang, label, view) -> places of both views instead of the text."""

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = [_clean(t) for t in b.column("text").to_pylist()]
            for i, j in batches(texts):
                part = b.slice(i, j - i)
                meta = meta_features(texts[i:j], part.column("source").to_pylist(), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sets(texts[i:j])], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary()), part.column("label"), part.column("view")], names=["doc_id", "text", "meta", "label", "view"])

    return rows.select("doc_id", "text", "source", "lang", "label", "view").mapInArrow(features, "doc_id bigint, text binary, meta binary, label int, view int")


def _fit(rows: DataFrame) -> dict:
    """rows of _featured; view: whom a pseudo-label is for, -1 for labelled rows. One task fits both models."""

    def fitted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows = [r for b in frames for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0]), 7), r[4], r[1]))  # no order of ids, the same in any run
        places = lambda x: np.frombuffer(x, dtype=np.int32)
        labelled = [(places(r[1]), places(r[2]), r[3]) for r in rows if r[4] < 0]
        told = tuple([(places(r[1 + v]), r[3]) for r in rows if r[4] == v] for v in (0, 1))
        views = learn_views(labelled, told)
        out = []
        for v in views:
            used = np.flatnonzero(v.dense).astype(np.int32)
            out += [used.tobytes(), v.dense[used].tobytes(), v.intercept]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*out, combine(labelled, views).tobytes(), *quotas(labelled), prior(labelled))], names=names)

    names = ["t_used", "t_weights", "t_intercept", "m_used", "m_weights", "m_intercept", "both", "bad", "good", "prior"]
    schema = "t_used binary, t_weights binary, t_intercept double, m_used binary, m_weights binary, m_intercept double, both binary, bad bigint, good bigint, prior double"
    r = rows.repartition(1).mapInArrow(fitted, schema).collect()[0]
    return {k: bytes(v) if isinstance(v, (bytes, bytearray)) else v for k, v in r.asDict().items()}


def train(docs: DataFrame, labels: DataFrame, learn_from, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict:
    """Fits on docs(doc_id, text, source, lang) and labels(doc_id, quality), where learn_from (a condition on doc_id)
    holds. Contradicting labels count as bad; null labels are left out. Labelled rows that weren't chosen are as good as
    unlabelled ones."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(learn_from).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    share = min(1.0, 0.97 * max_labelled / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = F.broadcast(chosen)  # max_labelled rows, 12 bytes each
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    once = [c for c in rows.columns if c != "doc_id"]
    # Of rows that repeat an id, the one whose text has the least hash.
    least = F.min(F.struct(F.xxhash64("text").alias("h"), *once)).alias("x")
    labelled = rows.join(chosen, "doc_id").groupBy("doc_id").agg(least, F.first("label").alias("label")).select("doc_id", "x.text", "x.source", "x.lang", "label", F.lit(-1).alias("view"))
    learnt = materialise(_featured(labelled), "quality-labelled")
    model = _fit(learnt)
    pool = rows.filter(learn_from).join(chosen, "doc_id", "left_anti")
    if pool.isEmpty():
        return model
    taken: DataFrame | None = None
    for _ in range(rounds):
        left = pool if taken is None else pool.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_anti")
        best = _surest(left, model)
        if best.isEmpty():
            break
        learnt_now = left.join(F.broadcast(best), "doc_id").groupBy("doc_id", "view", "label").agg(least).select("doc_id", "x.text", "x.source", "x.lang", "label", "view")
        learnt_now = materialise(_featured(learnt_now), "quality-told")
        learnt = learnt.unionByName(learnt_now)
        taken = best if taken is None else taken.unionByName(best)
        model = _fit(learnt)
    return model


def _surest(pool: DataFrame, model: dict) -> DataFrame:
    """Of all rows of pool those that each view is surest of: doc_id, label, view (the other one). As many as the
    model's quotas at most, which go with the labelled rows; of rows that repeat an id one counts."""
    spark = pool.sparkSession
    weights = spark.sparkContext.broadcast(_dense(model))  # 2^TEXT_BITS + 2^META_BITS floats
    intercepts = model["t_intercept"], model["m_intercept"]

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            odds = _odds([_clean(t) for t in b.column("text").to_pylist()], b.column("source").to_pylist(), b.column("lang").to_pylist(), weights.value, intercepts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(odds[0]), pa.array(odds[1])], names=["doc_id", "o0", "o1"])

    odds = materialise(pool.mapInArrow(scored, "doc_id bigint, o0 double, o1 double"), "quality-odds")
    least = float(np.log(SURE / (1 - SURE)))
    tie = F.xxhash64(F.lit("pool"), "doc_id")
    parts = []
    for v in (0, 1):
        for label, many in enumerate((model["bad"], model["good"])):
            sure = (F.col(f"o{v}") - F.lit(model["prior"])) * (1 if label else -1)
            of = odds.select("doc_id", sure.alias("sure")).filter(F.col("sure") >= least).groupBy("doc_id").agg(F.max("sure").alias("sure"))
            parts.append(of.orderBy(F.desc("sure"), tie, "doc_id").limit(max(1, int(many))).select("doc_id", F.lit(label).alias("label"), F.lit(1 - v).alias("view")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = materialise(both, "quality-surest")
    discard(odds)
    return out


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text, source, lang) -> doc_id, text_score, meta_score, score (0 to 1, higher: better)."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(_dense(model))

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.frombuffer(model["both"])
        for b in frames:
            odds = _odds([_clean(t) for t in b.column("text").to_pylist()], b.column("source").to_pylist(), b.column("lang").to_pylist(), weights.value, (model["t_intercept"], model["m_intercept"]))
            views = odds[0] * c[0] + c[1], odds[1] * c[2] + c[3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(_sigmoid(x)) for x in (*views, views[0] * c[4] + views[1] * c[5] + c[6]))], names=["doc_id", "text_score", "meta_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return rows.mapInArrow(scored, "doc_id bigint, text_score double, meta_score double, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, text_score, meta_score, score, predicted (1: good, score >= 0.5).

    Labels are learnt outside the fold held out (crc32 of the id modulo 5 is 0). Null texts count as empty; without
    labels all scores are those of the intercepts. An empty table gives an empty result.
    """
    held = fold("doc_id", 5)
    model = train(docs, labels, held != 0)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
