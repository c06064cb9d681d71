"""Language-model scores by a hierarchical Pitman-Yor model over the whole vocabulary.

Restaurants. Each word that occurs is a context and has a restaurant for the words that follow it; a text's end is the
context of the next text's first word. All these share the root restaurant as their parent: a table there is a customer
of the root, whose own parent is uniform over the V known words and one dish for all unknown ones.

Seating. Only the number of tables of each dish of each restaurant is kept, as the sizes can be summed out: c customers
sit at t tables with a weight of S(c, t) * a^t, where S are the generalised Stirling numbers of the discount and a is
(strength + discount * tables) times the dish's probability in the parent, both but for the cell's own tables and growing
with each of them. A Gibbs sweep draws the tables of every
dish of every restaurant anew, over all its customers; dishes with one customer have one table. All cells are drawn at
once, given the other cells' tables of the sweep before, as is usual for Gibbs sampling over many machines. After
burn-in the predictive probabilities of the following seatings are averaged.

Dealing. A chunk is what one task read, up to CHUNK_BYTES of text. It sends the words that it holds, once each, to the
buckets that own their hashes, which number them and add up. Pairs of numbers then go to shards by *both* words, so that
no restaurant, however large, is one task's burden; what belongs to a word (tables of its restaurant, customers and tables
of it in the root) is added up by its bucket and told to the shards that asked. The shards are a grid: a context's bucket
gives the row, a dish's bucket the column. So a bucket and the shards of one row and one column tell each other something,
and n buckets send some 2 n^1.5 messages a step, not n^2. There are as many buckets as spark.sql.shuffle.partitions, and
as many shards as make a grid of these. Chunks, counts and seatings are written between the steps. Words are told apart by
64-bit hashes. The driver holds a few numbers for each bucket.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import fold, packed, shared_dir, small_batches, unpacked
from strandwise.llm.words import batches, hashed

#: Bytes of text in a chunk.
CHUNK_BYTES = 12_000_000
STRENGTH = 1.0
BURN_IN, SAMPLES = 3, 3
#: Customers up to which the Stirling numbers are used themselves; beyond, their limit for many customers carries on.
EXACT = 32
#: The token that ends a text, and the context of the first word.
END = 0xE7D0_0000_0000_0001

#: What the steps send each other: dest has the rows that it gets sorted by kind and src.
_NAMES = ["deal", "dest", "kind", "src", "a", "b", "c", "d"]
_SCHEMA = "deal bigint, dest bigint, kind int, src bigint, a binary, b binary, c binary, d binary"
_WORDS, _CHUNK, _ANSWER, _PAIRS, _COUNTS, _PLACES, _ACTIVE, _BASE, _SUMS, _TABLES, _SAMPLE, _FOUND, _TOLD, _SUMMARY = range(14)
Row = tuple[int, int, int, int, bytes | None, bytes | None, bytes | None, bytes | None]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text's end included, and where each text begins (and the end)."""
    h, begin, *_ = hashed(texts)
    return np.insert(h, begin[1:], np.uint64(END)), begin + np.arange(len(begin))


def lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


def rising(x: np.ndarray) -> bytes:
    """Integers in rising order, by their steps."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def risen(b: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(unpacked(b, kind), dtype=kind)


class _Table:
    """What a step sent, written to the shared folder by kind, so that each kind can go when nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/strandwise/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy("kind").parquet(self.path)

    def _folder(self, kind: int):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kind={kind}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def of(self, kind: int) -> DataFrame:
        folder, files = self._folder(kind)
        if not files.exists(folder):
            return self.spark.createDataFrame([], _SCHEMA)
        schema = ", ".join(x for x in _SCHEMA.split(", ") if not x.startswith("kind "))
        return self.spark.read.schema(schema).parquet(str(folder)).withColumn("kind", F.lit(kind)).select(*_NAMES)

    def summary(self) -> list[tuple[int, np.ndarray]]:
        """A few numbers from each dest."""
        return [(r["src"], unpacked(bytes(r["a"]), np.int64)) for r in self.of(_SUMMARY).select("src", "a").collect()]

    def drop(self, *kinds: int) -> None:
        """Deletes these kinds, and lets Spark delete the shuffles of plans that are gone."""
        for kind in kinds:
            folder, files = self._folder(kind)
            files.delete(folder, True)
        gc.collect()
        self.spark._jvm.System.gc()


def _records(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    wait: list[Row] = []
    size = 0
    for r in rows:
        wait.append(r)
        size += sum(len(x) for x in r[4:] if x)
        if size > 1 << 24 or len(wait) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*wait), kinds)], names=_NAMES)
            wait, size = [], 0
    if wait:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*wait), kinds)], names=_NAMES)


def _groups(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each dest: (kind, src, a, b, c, d)."""
    now, rows = None, []
    for b in frames:
        for _, dest, *r in zip(*(c.to_pylist() for c in b.columns)):
            if dest != now:
                if rows:
                    yield now, rows
                now, rows = dest, []
            rows.append(r)
    if rows:
        yield now, rows


def _give_back() -> None:
    """Hands freed memory back to the system: Spark keeps a Python worker for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _step(sent: DataFrame, parts: int | None, work: Callable[[int, list[tuple]], Iterable[Row]]) -> DataFrame:
    """Each dest's rows through work."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _records(r for dest, rows in _groups(frames) for r in work(dest, rows))
        _give_back()

    dealt = sent.repartition(parts, "deal") if parts else sent.repartition("deal")
    return dealt.sortWithinPartitions("dest", "kind", "src").mapInArrow(run, _SCHEMA)


def _keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n partitions that Spark deals to just that one, so that none has two dests and another none."""
    found: dict[int, int] = {}
    size = 8 * n
    while len(found) < n:
        size *= 2
        part = F.pmod(F.hash("id"), F.lit(n))
        found = {r["p"]: r["k"] for r in spark.range(size).groupBy(part.alias("p")).agg(F.min("id").alias("k")).collect()}
    return [found[j] for j in range(n)]


def _cuts(owner: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Of sorted owners, the slice of each that occurs."""
    at = np.searchsorted(owner, np.arange(n + 1))
    return [(j, slice(at[j], at[j + 1])) for j in range(n) if at[j] < at[j + 1]]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Whose a hash is; rises with the hash."""
    return (((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def _grid(n: int) -> tuple[int, int]:
    """Rows and columns of the shards, n at most."""
    rows = max(1, int(n**0.5))
    return rows, n // rows


def _shard(context: np.ndarray, dish: np.ndarray, n: int) -> np.ndarray:
    """Whose a pair is, by the buckets of its words. Those of one row are in different columns."""
    rows, columns = _grid(n)
    return context % rows * columns + dish // rows % columns


def read_chunks(docs: DataFrame, keys: list[int], chunk_bytes: int) -> DataFrame:
    """docs(doc_id, text, learn) -> the chunks, as places in their own sorted words, and their words to the buckets."""
    n = len(keys)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        wait: list[tuple[int | None, bool, bytes]] = []
        size = 0

        def chunk() -> Iterator[Row]:
            texts = [t for *_, t in wait]
            parts = [tokens(texts[i:j]) for i, j in batches(texts)]
            length = np.concatenate([np.diff(begin) for _, begin in parts])
            u, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            learn = np.array([x for _, x, _ in wait])
            count = np.bincount(at, weights=np.repeat(learn, length), minlength=len(u)).astype(np.int64)
            ids = np.array([i or 0 for i, *_ in wait], dtype=np.int64)
            flags = learn.astype(np.int8) + 2 * np.array([i is None for i, *_ in wait], dtype=np.int8)
            yield number, number, _CHUNK, 0, packed(ids), packed(flags), packed(length.astype(np.int64)), packed(at.astype(np.int32))
            for j, s in _cuts(_bucket(u, n), n):
                yield keys[j], j, _WORDS, number, rising(u[s]), packed(count[s]), None, None

        for b in frames:
            for i, learn, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "learn", "text"))):
                wait.append((i, learn, lower(text)))
                size += len(wait[-1][2])
                if size >= chunk_bytes:
                    yield from _records(chunk())
                    number += 1
                    wait, size = [], 0
        if wait:
            yield from _records(chunk())
        wait.clear()
        _give_back()

    return docs.select("doc_id", "learn", "text").mapInArrow(run, _SCHEMA)


def number_words(bucket: int, rows: list[tuple]) -> Iterator[Row]:
    """Of a bucket: to each chunk the places of its words in the bucket and their counts, and a summary."""
    words = [risen(a, np.uint64) for _, _, a, *_ in rows]
    counts = [unpacked(b, np.int64) for _, _, _, b, *_ in rows]
    u, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
    end = 0
    for (_, chunk, *_), w in zip(rows, words):
        own = at[end : end + len(w)]
        end += len(w)
        yield chunk, chunk, _ANSWER, bucket, rising(own.astype(np.int64)), packed(total[own]), None, None
    yield 0, -1, _SUMMARY, bucket, packed(np.array([len(u), (total > 0).sum(), total.sum()], dtype=np.int64)), None, None, None


class _Chunk:
    """A chunk's tokens, with the numbers of its words and their counts."""

    def __init__(self, rows: list[tuple], offsets: np.ndarray):
        own = next(r for r in rows if r[0] == _CHUNK)
        ids, flags = unpacked(own[2], np.int64), unpacked(own[3], np.int8)
        self.learn, self.doc_id = (flags & 1).astype(bool), pa.array(ids, mask=(flags & 2).astype(bool))
        self.length, self.token = unpacked(own[4], np.int64), unpacked(own[5], np.int32).astype(np.int64)
        answers = [r for r in rows if r[0] == _ANSWER]
        self.place = [(r[1], risen(r[2])) for r in answers]
        self.word = np.concatenate([offsets[j] + p for j, p in self.place])
        self.bucket = np.repeat([j for j, _ in self.place], [len(p) for _, p in self.place])
        self.count = np.concatenate([unpacked(r[3], np.int64) for r in answers])
        self.begin = np.cumsum(self.length) - self.length
        end = self.token[-1]  # each text's last token is its end
        self.before = np.concatenate(([end], self.token[:-1]))
        self.before[self.begin] = end

    def pairs(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, context, word and learnt occurrences of each pair, sorted by these, and which pair each token is."""
        n = len(self.word)
        pair, at = np.unique(self.before * n + self.token, return_inverse=True)
        u, w = self.word[pair // n], self.word[pair % n]
        owner = _shard(self.bucket[pair // n], self.bucket[pair % n], n_buckets)
        seen = np.bincount(at, weights=np.repeat(self.learn, self.length), minlength=len(pair)).astype(np.int64)
        order = np.lexsort((w, u, owner))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return owner[order], u[order], w[order], seen[order], rank[at]


def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row c, column t, for c and t from 0 to n."""
    s = np.zeros((n + 1, n + 1))
    s[0, 0] = 1
    t = np.arange(n + 1)
    for c in range(n):
        s[c + 1, 1:] = s[c, :-1] + (c - d * t[1:]) * s[c, 1:] * (t[1:] <= c)
    with np.errstate(divide="ignore"):
        return np.log(s)


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, draw: np.random.Generator, more: Callable | None = None) -> np.ndarray:
    """Tables of c customers, drawn with weights S(c, t) * a^t.

    Up to EXACT customers these weights themselves are used. With more, each further customer multiplies the weights'
    generating function by what tends to a flow in log c, whose solution is: the tables that EXACT customers would have
    under a * r, and a Poisson number with mean a / d * (1 - r), where r = (c / EXACT)^-d.

    more(cells, j): where a grows with the tables, its factor for the j-th further table of these cells, in the place of
    a alone; used for the first EXACT tables.
    """
    t = np.ones(len(c), dtype=np.int64)
    logs = stirling(d)
    few = np.minimum(c, EXACT)
    r = (np.maximum(c, EXACT) / EXACT) ** -d
    for k in range(2, EXACT + 1):
        at = np.flatnonzero(few == k)
        for i in range(0, len(at), 1 << 16):
            own = at[i : i + (1 << 16)]
            each = np.maximum(a[own, None] * np.ones(k) if more is None else more(own, np.arange(k)), 1e-300)
            w = logs[k, 1 : k + 1] + np.cumsum(np.log(each) + np.log(r[own])[:, None], axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (w < (draw.random(len(own)) * w[:, -1])[:, None]).sum(axis=1)
    many = c > EXACT
    t[many] += draw.poisson(a[many] / d * (1 - r[many]))
    return np.minimum(t, c)


def discount(once: float, twice: float) -> float:
    """The usual estimate from the numbers of dishes eaten once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def parent(customers: np.ndarray, tables: np.ndarray, root: dict) -> np.ndarray:
    """Probabilities of dishes in the root, of which root has the totals."""
    return (customers - root["d"] * tables + root["new"]) / (STRENGTH + root["customers"])


def _sums(kind: int, u: np.ndarray, w: np.ndarray, t: np.ndarray, offsets: np.ndarray, keys: list[int], shard: int) -> Iterator[Row]:
    """Tables by context and by dish, to the buckets of these words."""
    parts: dict[int, list] = {}
    for role, x in enumerate((u, w)):
        ids, at = np.unique(x, return_inverse=True)
        n = np.bincount(at, weights=t, minlength=len(ids)).astype(np.int64)
        for j, s in _cuts(np.searchsorted(offsets, ids, side="right") - 1, len(keys)):
            parts.setdefault(j, [np.zeros(0, np.int64)] * 4)[2 * role : 2 * role + 2] = ids[s] - offsets[j], n[s]
    for j, (iu, nu, iw, nw) in parts.items():
        yield keys[j], j, kind, shard, rising(iu), packed(nu), rising(iw), packed(nw)


def _add(rows: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each of a bucket's words as a context, and as a dish: what the shards told, added up."""
    opens, customers = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for _, _, *x in rows:
        opens[risen(x[0])] += unpacked(x[1], np.int64)
        customers[risen(x[2])] += unpacked(x[3], np.int64)
    return opens, customers


def _added(kind: int, key: int, bucket: int, rows: list[tuple], size: int) -> Row:
    """The same as one row."""
    both = _add(rows, size)
    at = [np.flatnonzero(x) for x in both]
    return key, bucket, kind, bucket, rising(at[0]), packed(both[0][at[0]]), rising(at[1]), packed(both[1][at[1]])


def _unique_pairs(us: list[np.ndarray], ws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and which of them each pair is."""
    names, a = np.unique(np.concatenate(us), return_inverse=True)
    dishes, b = np.unique(np.concatenate(ws), return_inverse=True)
    pair, at = np.unique(a * len(dishes) + b, return_inverse=True)
    return names[pair // max(1, len(dishes))], dishes[pair % max(1, len(dishes))], at


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty: the end alone. Rows with a null id are learnt from. Without a learnt text all words are
    the unknown one, and each score is 0. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 64)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(spark, n)
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("learn"))
    read = _Table(read_chunks(given, keys, chunk_bytes), "lm-chunks")
    words = _Table(_step(read.of(_WORDS), n, number_words), "lm-words")
    read.drop(_WORDS)
    told = dict(words.summary())
    sizes = np.array([told[j][0] if j in told else 0 for j in range(n)])
    offsets = np.cumsum(sizes) - sizes
    n_words, n_all = (int(sum(x[k] for x in told.values())) for k in (1, 2))
    chunks = read.of(_CHUNK).unionByName(words.of(_ANSWER))

    def send_pairs(chunk: int, rows: list[tuple]) -> Iterator[Row]:
        owner, u, w, seen, _ = _Chunk(rows, offsets).pairs(n)
        for j, s in _cuts(owner, n):
            yield keys[j], j, _PAIRS, chunk, rising(u[s]), packed(w[s]), packed(seen[s]), None

    pairs = _Table(_step(chunks, None, send_pairs), "lm-pairs")

    def seat(shard: int, rows: list[tuple]) -> Iterator[Row]:
        """The shard's pairs in order, unlearnt ones too: their counts, where each chunk's are among them, and those with
        several customers as cells to be seated. The others' tables are known, and only added up."""
        u, w, at = _unique_pairs([risen(r[2]) for r in rows], [unpacked(r[3], np.int64) for r in rows])
        times = [unpacked(r[4], np.int64) for r in rows]
        c = np.bincount(at, weights=np.concatenate(times), minlength=len(u)).astype(np.int64)
        one, more = c == 1, c > 1
        yield keys[shard], shard, _COUNTS, shard, packed(c), None, None, None
        end = 0
        for r, x in zip(rows, times):
            yield keys[shard], shard, _PLACES, r[1], rising(at[end : end + len(x)].astype(np.int64)), None, None, None
            end += len(x)
        t = np.ones(int(more.sum()), dtype=np.int64)
        yield keys[shard], shard, _ACTIVE, shard, rising(u[more]), packed(w[more]), packed(c[more]), packed(np.concatenate((t, 0 * t)))
        yield 0, -1, _SUMMARY, shard, packed(np.array([one.sum(), (c == 2).sum()], dtype=np.int64)), None, None, None
        yield from _sums(_BASE, u[one], w[one], np.ones(int(one.sum())), offsets, keys, shard)
        yield from _sums(_SUMS, u[more], w[more], t, offsets, keys, shard)

    cells = _Table(_step(pairs.of(_PAIRS), n, seat), "lm-cells")
    pairs.drop(_PAIRS)
    d = discount(*sum((x for _, x in cells.summary()), np.zeros(2, np.int64)))
    base = _Table(_step(cells.of(_BASE), n, lambda bucket, rows: [_added(_BASE, keys[bucket], bucket, rows, sizes[bucket])]), "lm-base")
    cells.drop(_BASE)
    root = {"d": 0.5, "tables": n_words}
    state = cells
    sampled: list[tuple[_Table, dict]] = []
    for k in range(burn_in + samples):
        state, root, told_words = _sweep(state, base, root, d, sizes, offsets, keys, n_words, k, k >= burn_in, k + 1 == burn_in + samples)
        if k >= burn_in:
            sampled.append((told_words, root))

    def found(shard: int, rows: list[tuple]) -> Iterator[Row]:
        """Of each pair that a chunk has: its customers, less what the discount takes off."""
        value = np.zeros(0, dtype=np.float32)
        for kind, chunk, a, _, _, t in rows:  # counts, then places, then cells: by kind
            if kind == _COUNTS:
                c = unpacked(a, np.int64)
            elif kind == _ACTIVE:
                less = unpacked(t, np.int64)
                value = np.where(c > 0, c - d, 0.0)
                value[c > 1] = c[c > 1] - d * less[len(less) // 2 :] / samples
                value = value.astype(np.float32)
        for kind, chunk, a, *_ in rows:
            if kind == _PLACES:
                yield chunk, chunk, _FOUND, shard, packed(value[risen(a)]), None, None, None

    replies = _step(cells.of(_COUNTS).unionByName(cells.of(_PLACES)).unionByName(state.of(_ACTIVE)), n, found)

    def tell(bucket: int, rows: list[tuple]) -> Iterator[Row]:
        """To each chunk, of its words and each seating: tables, and customers and tables in the root."""
        seats = [np.array([unpacked(x, np.int64) for x in r[2:5]]) for r in rows if r[0] == _SAMPLE]
        seats = seats or [np.zeros((3, sizes[bucket]), dtype=np.int64)] * samples  # none of its words was learnt
        for kind, chunk, a, *_ in rows:
            if kind == _ANSWER:
                own = risen(a)
                yield chunk, chunk, _TOLD, bucket, packed(np.concatenate([s[:, own].ravel() for s in seats])), None, None, None

    deal = F.element_at(F.array(*[F.lit(x) for x in keys]), (F.col("src") + 1).cast("int"))
    wanted = words.of(_ANSWER).select(deal.alias("deal"), F.col("src").alias("dest"), "kind", F.col("dest").alias("src"), "a", "b", "c", "d")
    for told_words, _ in sampled:
        wanted = wanted.unionByName(told_words.of(_SAMPLE))
    replies = replies.unionByName(_step(wanted, n, tell))
    roots = [r for _, r in sampled]

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(frames):
            chunk = _Chunk(rows, offsets)
            *_, at = chunk.pairs(n)
            seats = np.concatenate([unpacked(r[2], np.int64).reshape(3 * len(roots), -1) for r in rows if r[0] == _TOLD], axis=1)
            context = STRENGTH + chunk.count[chunk.before]
            p = np.zeros(len(chunk.token))
            for k, r in enumerate(roots):
                opens, customers, tables = seats[3 * k : 3 * k + 3]
                p += (STRENGTH + d * opens)[chunk.before] * parent(customers, tables, r)[chunk.token]
            p = (np.concatenate([unpacked(r[2], np.float32) for r in rows if r[0] == _FOUND])[at] + p / len(roots)) / context
            base = np.log10((chunk.count + 1) / (n_all + n_words + 1))
            add = lambda x: pa.array(np.add.reduceat(x, chunk.begin))
            yield pa.RecordBatch.from_arrays(
                [chunk.doc_id, pa.array(~chunk.learn), pa.array(chunk.length), add((chunk.count > 0)[chunk.token].astype(np.int64)), pa.array(np.full(len(chunk.length), n_all, dtype=np.int64)), add(base[chunk.token]), add(np.log10(p))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del chunk, at, seats, context, p
        _give_back()

    together = chunks.unionByName(replies).repartition("deal").sortWithinPartitions("dest", "kind", "src")
    return together.mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _sweep(state: _Table, base: _Table, root: dict, d: float, sizes: np.ndarray, offsets: np.ndarray, keys: list[int], n_words: int, k: int, sample: bool, last: bool) -> tuple[_Table, dict, _Table]:
    """One Gibbs sweep: the root's tables, then, but for the last time, those of all other restaurants.

    Gives the new seating, the root's totals, and, for a sample, what the buckets know of each word in the old seating.
    """
    n, was = len(keys), dict(root)

    def root_tables(bucket: int, rows: list[tuple]) -> Iterator[Row]:
        opens, customers = _add(rows, sizes[bucket])
        tables = np.zeros(len(opens), dtype=np.int64)
        some = customers > 0
        a = np.full(int(some.sum()), (STRENGTH + was["d"] * max(0, was["tables"] - 1)) / (n_words + 1))
        tables[some] = draw_tables(customers[some], a, was["d"], np.random.default_rng([k, bucket, 1]))
        yield 0, -1, _SUMMARY, bucket, packed(np.array([customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()], dtype=np.int64)), None, None, None
        if sample:
            yield keys[bucket], bucket, _SAMPLE, k, packed(opens), packed(customers), packed(tables), None
        for kind, shard, *x in rows:
            if kind == _SUMS and not last:
                iu, iw = risen(x[0]), risen(x[2])
                yield keys[shard], shard, _TABLES, bucket, x[0], packed(opens[iu]), x[2], packed(np.concatenate((customers[iw], tables[iw])))

    told = _Table(_step(state.of(_SUMS).unionByName(base.of(_BASE)), n, root_tables), "lm-root")
    state.drop(_SUMS)
    total = sum((x for _, x in told.summary()), np.zeros(4, np.int64))
    # This seating's probabilities go with the discount that it was drawn with; the next one's follows from it.
    now = {"d": was["d"], "tables": int(total[1]), "customers": int(total[0])}
    now["new"] = (STRENGTH + now["d"] * now["tables"]) / (n_words + 1)
    following = now | {"d": discount(float(total[2]), float(total[3]))} if not sample else now

    def reseat(shard: int, rows: list[tuple]) -> Iterator[Row]:
        cells = next((r for r in rows if r[0] == _ACTIVE), None)
        if cells is None:
            return
        u, w, c = risen(cells[2]), unpacked(cells[3], np.int64), unpacked(cells[4], np.int64)
        t, total_t = np.split(unpacked(cells[5], np.int64), 2)
        if sample:
            total_t = total_t + t
        if not last and len(c):
            asks = [r for r in rows if r[0] == _TABLES]
            names = np.concatenate([offsets[r[1]] + risen(r[2]) for r in asks])
            opens = np.concatenate([unpacked(r[3], np.int64) for r in asks])[np.searchsorted(names, u)]
            dishes = np.concatenate([offsets[r[1]] + risen(r[4]) for r in asks])
            both = np.concatenate([unpacked(r[5], np.int64).reshape(2, -1) for r in asks], axis=1)[:, np.searchsorted(dishes, w)]
            others, own = both[0] - t, opens - t  # customers of the dish in the root and tables here, but for this cell's
            rest = STRENGTH + now["customers"] - t
            high = np.maximum(others - now["d"] * np.minimum(both[1], others), 0) + now["new"]

            def more(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """Each further table counts here and, as a customer, in the root."""
                return (STRENGTH + d * (own[i, None] + j)) * (high[i, None] + np.maximum(j - now["d"] * (others[i, None] == 0), 0)) / (rest[i, None] + j)

            a = (STRENGTH + d * (own + t / 2)) * (high + t / 2) / (rest + t / 2)
            t = draw_tables(c, a, d, np.random.default_rng([k, shard, 2]), more)
        yield keys[shard], shard, _ACTIVE, shard, cells[2], cells[3], cells[4], packed(np.concatenate((t, total_t)))
        if not last:
            yield from _sums(_SUMS, u, w, t, offsets, keys, shard)

    new = _Table(_step(state.of(_ACTIVE).unionByName(told.of(_TABLES)), n, reseat), "lm-seating")
    told.drop(_TABLES)
    state.drop(_ACTIVE)
    return new, following, told


def perplexity(scored: DataFrame) -> DataFrame:
    """scored by score() -> held_out, tokens, perplexity."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
