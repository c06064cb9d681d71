"""Byte-level BPE encoding and decoding with a public rank file, by overlapping chunks.

A text of over LONG characters is cut into chunks of that length, which overlap and are dealt out as rows. Each chunk is
split by the pre-token pattern and encoded on its own, in parallel: its pieces' bytes are merged, lowest rank first.
Where one chunk ends and the next began, the ends of both scans' pieces are compared: a match of the pattern depends
only on where it begins and on what follows, so from the first end that both have they agree for good, and the chunks'
ids are stitched there. Ends close to a chunk's end aren't trusted, as what follows is missing. A text with an overlap
without a common end, that is with a piece longer than an overlap, is split in one go. Shorter texts are one chunk.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from strandwise.llm.common import materialise, packed, small_batches, unpacked

LONG, OVERLAP = 8192, 256
#: A contraction is the longest that a pattern looks ahead; ends closer to a chunk's end aren't trusted.
TAIL = 4
#: Pieces that a worker remembers, and their length at most.
CACHE, MEMORABLE = 1 << 18, 64


def pattern(text: str):
    """The pre-token pattern, with \\s as Unicode has it."""
    import regex

    return regex.compile(text, regex.V0 | regex.UNICODE)


#: What the pattern's classes are within ASCII, in brackets of the pattern and by themselves.
_ASCII = {r"\s": (r"\t-\r ", r"[\t-\r ]"), r"\S": (None, r"[^\t-\r ]"), r"\p{L}": ("A-Za-z", "[A-Za-z]"), r"\p{N}": ("0-9", "[0-9]")}


def ascii_pattern(text: str):
    """The pattern for texts that are ASCII only, for the faster standard engine; None if it has other escapes."""
    import re

    out, at, inside = [], 0, False
    while at < len(text):
        found = next((k for k in _ASCII if text.startswith(k, at)), None)
        if found:
            out.append(_ASCII[found][0 if inside else 1])
        elif text[at] == "\\" or text.startswith("(?i", at):
            return None
        else:
            inside = text[at] == "[" or inside and text[at] != "]"
            out.append(text[at])
        if out[-1] is None:
            return None
        at += len(found or " ")
    compiled = re.compile("".join(out))
    return None if compiled.groups else compiled


class _Known(dict):
    """Ids of the pieces that were met, worked out when a piece is asked for first. Once it is full it becomes the older
    half, whose pieces come back when they are met again."""

    def __init__(self, merge):
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "replace"))
        if len(piece) <= MEMORABLE:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ranks and the pre-token pattern; encodes pieces and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pat: str):
        self.ranks, self.find, self.ascii = ranks, pattern(pat), ascii_pattern(pat)
        self.bytes = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in self.bytes}
        self.known = _Known(self.merge)

    @classmethod
    def load(cls, path: str, pat: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pat)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the adjacent pair of lowest rank, the leftmost of these, is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long pieces, with a heap over a linked list."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins there
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        rank = lambda i: ranks.get(piece[i : end[end[i]]]) if end[i] < n else None
        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            r, i, stop = heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or ranks.get(piece[i:stop]) != r:
                continue
            gone = end[i]
            alive[gone] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            for j in (before[i], i):
                if j >= 0 and (x := rank(j)) is not None:
                    heappush(heap, (x, j, end[end[j]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of text, which cover it."""
        if self.ascii and text.isascii():
            return self.ascii.findall(text)
        return [m.group() for m in self.find.finditer(text)] if self.find.groups else self.find.findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """The chunks of a text: number, characters (the overlap with the next one included), whether it is the last."""
    for k, i in enumerate(range(0, max(1, len(text)), size)):
        yield k, text[i : i + size + overlap], i + size >= len(text)


def encode_chunk(encoder: Encoder, part: str, size: int, overlap: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk by itself: the ids of its pieces; pairs (place, ids before it) of the ends in its first overlap characters,
    its begin included; and those of the sure ends in the overlap with the next chunk, counted from where that begins."""
    pieces = encoder.pieces(part)
    ids = [encoder.known[p] for p in pieces]
    ends = np.cumsum([0, *map(len, pieces)])
    before = np.cumsum([0, *map(len, ids)])
    both = np.column_stack([ends, before]).astype(np.int32)
    head = both[ends <= overlap]
    tail = both[(ends >= size) & (ends <= len(part) - TAIL)] if not last else both[:0]
    return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(before[-1])), head, tail - np.array([size, 0], dtype=np.int32)


class Stitcher:
    """Joins a text's chunks, which come in order: those before and after an overlap agree from the first end on that
    both have. fine: every overlap had one."""

    def __init__(self):
        self.ids: np.ndarray | None = None
        self.begin, self.tail, self.fine = 0, None, True

    def add(self, ids: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The ids that are sure by now, after those that were told before."""
        told, begin = np.zeros(0, dtype=np.int32), 0
        if self.ids is not None and self.fine:
            _, own, other = np.intersect1d(self.tail[:, 0], head[:, 0], return_indices=True)
            if len(own):
                told, begin = self.ids[self.begin : self.tail[own[0], 1]], head[other[0], 1]
            else:
                self.fine = False
        self.ids, self.begin, self.tail = ids, begin, tail
        return told

    def rest(self) -> np.ndarray:
        return self.ids[self.begin :]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_loaded: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pat: str) -> Encoder:
    """One for each Python worker."""
    if (path, pat) not in _loaded:
        _loaded[path, pat] = Encoder.load(path, pat)
    return _loaded[path, pat]


class Digests:
    """Takes a text's ids in parts: n_tokens, ids_sha256, decoded_sha256."""

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kinds = (pa.int64(), pa.string(), pa.string())

    def __init__(self, encoder: Encoder):
        self.encoder, self.n, self.ids, self.decoded = encoder, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(((" " if self.n else "") + " ".join(map(self.encoder.decimal.__getitem__, ids))).encode())
            self.decoded.update(self.encoder.decode(ids))
            self.n += len(ids)

    def done(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


class Ids:
    """Takes a text's ids in parts: all of them."""

    schema = "ids array<int>"
    kinds = (pa.list_(pa.int32()),)

    def __init__(self, encoder: Encoder):
        self.ids: list[int] = []

    def add(self, ids: list[int]) -> None:
        self.ids += ids

    def done(self) -> tuple:
        return (self.ids,)


def token_ids(docs: DataFrame, kind, path: str | None = None, pat: str | None = None, long: int = LONG) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the columns of kind, which takes each row's ids in parts.

    Null texts count as empty. path: the rank file, on every executor at that place.
    """
    small_batches(docs.sparkSession, 256)
    if path is None:
        path, pat = default_vocabulary()
    size, overlap = max(1, long), max(1, min(OVERLAP, long))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = [c.split()[0] for c in kind.schema.split(", ")]

    def record(keys: pa.Array, key: str, told: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array([x[j] for x in told], t) for j, t in enumerate(kind.kinds))], names=[key, *names])

    def whole(key: str):
        def encoded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(path, pat)
            for b in frames:
                for i in range(0, b.num_rows, 64):
                    told = []
                    for t in b.column("text").slice(i, 64).to_pylist():
                        sink = kind(encoder)
                        sink.add(encoder.encode(t))
                        told.append(sink.done())
                    yield record(b.column(key).slice(i, len(told)), key, told)

        return encoded

    short = rows.filter(F.length("text") <= long).mapInArrow(whole("doc_id"), f"doc_id bigint, {kind.schema}")
    # Longer texts: a row for each chunk; equal texts once.
    lengthy = rows.filter(F.length("text") > long).withColumn("key", F.sha2("text", 256))

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                parts = list(cut(text, size, overlap))
                for i in range(0, len(parts), 256):
                    some = parts[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.string()), pa.array([x[2] for x in some])], names=["key", "k", "part", "last"])

    def chunks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pat)
        for b in frames:
            told = [encode_chunk(encoder, t, size, overlap, last) for t, last in zip(b.column("part").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), *(pa.array([packed(x[j].ravel()) for x in told], pa.binary()) for j in range(3))], names=["key", "k", "ids", "head", "tail"])

    def stitched(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted by text and number. A text without a common end in some overlap: nulls."""
        encoder = _encoder(path, pat)
        now = sink = joint = None

        def out() -> pa.RecordBatch:
            sink.add(joint.rest().tolist())
            return record(pa.array([now]), "key", [sink.done() if joint.fine else (None,) * len(names)])

        for b in frames:
            for key, *parts in zip(*(b.column(c).to_pylist() for c in ("key", "ids", "head", "tail"))):
                if key != now:
                    if now is not None:
                        yield out()
                    now, sink, joint = key, kind(encoder), Stitcher()
                ids, head, tail = (unpacked(x, np.int32) for x in parts)
                sink.add(joint.add(ids, head.reshape(-1, 2), tail.reshape(-1, 2)).tolist())
        if now is not None:
            yield out()

    # Equal texts' chunks merge where they are made and where they arrive: their rows cross the network once.
    dealt = lengthy.select("key", "text").mapInArrow(deal, "key string, k int, part string, last boolean").groupBy("key", "k", "last", "part").agg(F.count(F.lit(1)).alias("n"))
    pieces = dealt.mapInArrow(chunks, "key string, k int, ids binary, head binary, tail binary")
    schema = f"key string, {kind.schema}"
    told = materialise(pieces.repartition("key").sortWithinPartitions("key", "k").mapInArrow(stitched, schema), "bpe-long")
    fine = told.filter(F.col(names[0]).isNotNull())
    broken = told.filter(F.col(names[0]).isNull()).select("key")
    if not broken.isEmpty():  # a piece of more than an overlap: these texts are encoded in one go
        some = lengthy.join(materialise(broken, "bpe-broken"), "key", "left_semi").select("key", "text").distinct()
        fine = fine.unionByName(some.mapInArrow(whole("key"), schema))
    return short.unionByName(lengthy.select("doc_id", "key").join(fine, "key").select("doc_id", *names))


def encode(docs: DataFrame, path: str | None = None, pat: str | None = None, long: int = LONG) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts count as empty."""
    return token_ids(docs, Digests, path, pat, long)


def encode_ids(docs: DataFrame, path: str | None = None, pat: str | None = None, long: int = LONG) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: the token ids themselves."""
    return token_ids(docs, Ids, path, pat, long)


def decode_ids(encoded: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, bytes: the bytes of the ids in order; null ids give null."""
    if path is None:
        path, pat = default_vocabulary()

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pat)
        for b in frames:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else encoder.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(each, StructType([encoded.schema["doc_id"], StructField("bytes", BinaryType())]))
