"""Document fingerprints: the canonical exact digest.

Canonical form: NFKC, case folding, NFKC once more, and each run of white space as one space (none at either end). The
fingerprint is its 128-bit XXH3 digest. Texts with one digest are one bucket, and within a bucket the canonical bytes
are compared: should a bucket hold different texts, which only an attack would bring about, all texts of that digest
get their SHA-256 appended. Only texts whose digest repeats are moved for that comparison: a bitmap of a fixed size
tells them when the texts are read again (a false hit moves one text more). Digests with different texts are told by
such a bitmap, too, so any number of them is handled; a false hit has its SHA-256 appended for nothing.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import materialise, small_batches

#: Places of the bitmap of repeated digests, 4 MB.
BITMAP = 1 << 25


def canonical(text: str) -> bytes:
    fold = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", fold).split()).encode("utf-8", "surrogatepass")


def xxh3(form: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form)


class Digests:
    """A set of digests as a bitmap of BITMAP places: has every digest that was put in, and perhaps others."""

    def __init__(self, found: DataFrame):
        """found(digest): distributed; BITMAP / 8 bytes at most come to the driver."""
        p = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % BITMAP + 1  # bitmaps count from 1
        places = found.select(p.alias("p"))
        bits = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        self.maps = {r["bucket"]: bytes(r["bits"]) for r in bits.collect()}

    def __bool__(self) -> bool:
        return bool(self.maps)

    def __contains__(self, digest: str) -> bool:
        p = int(digest[:8], 16) % BITMAP
        bits = self.maps.get(p // 32768 + 1)  # buckets count from 1, places within from 0
        return bits is not None and bool(bits[p % 32768 // 8] >> p % 8 & 1)


def shared_digests(docs: DataFrame, digest: Callable[[bytes], str] = xxh3) -> Digests:
    """Digests that different canonical texts of docs(text) have."""

    def digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield pa.RecordBatch.from_arrays([pa.array([digest(canonical(t or "")) for t in b.column(0).to_pylist()], pa.string())], names=["digest"])

    counts = docs.select("text").mapInArrow(digests, "digest string").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    often = Digests(counts.filter("n > 1"))
    if not often:
        return often

    def flagged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            out = []
            for t in b.column(0).to_pylist():
                if (d := digest(form := canonical(t or ""))) in often:
                    out.append((d, pa.compress(form, codec="zstd", asbytes=True)))  # lossless: equal only for equal bytes
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["digest", "form"])

    # Copies merge before they are sent, so a bucket of many is a row from each task.
    forms = docs.select("text").mapInArrow(flagged, "digest string, form binary").groupBy("digest", "form").agg(F.count(F.lit(1)).alias("n"))
    return Digests(forms.groupBy("digest").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1"))


def fingerprints(docs: DataFrame, digest: Callable[[bytes], str] = xxh3) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the text with its last third replaced by the beginning of the next document's, by descending
    doc_id; null ids are the last, rows that repeat an id go by their text's hash, and after the last row comes the first. A
    single row is its own next. An exact fingerprint is like another (1.0) or not (0.0). Null text counts as empty.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    shared = shared_digests(docs, digest)

    def print_of(text: str) -> str:
        d = digest(form := canonical(text))
        return f"{d}-{hashlib.sha256(form).hexdigest()}" if d in shared else d

    def row(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        other = own if edited == text else print_of(edited)
        if other == own and edited != text and canonical(edited) != canonical(text):  # compared by bytes, as in a bucket
            other = f"{own}-{hashlib.sha256(canonical(edited)).hexdigest()}"
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, n, sha, own, other, float(own == other), float(own == following_print)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def record(rows: list[tuple], extra: list[tuple] | None = None) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        if extra is None:
            return pa.RecordBatch.from_arrays(arrays, names=names)
        more = [pa.array([x[0] for x in extra], pa.string()), pa.array([x[1] for x in extra], pa.int32()), pa.array([x[2] for x in extra], pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *more], names=[*names, "kind", "part", "text"])

    def ranges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by ascending id, so the row before is the next. The first row's next is the last of another part:
        both are handed on with their texts."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = None
        for b in frames:
            rows, extra = [], []
            for doc_id, packed, size in zip(*(b.column(c).to_pylist() for c in ("doc_id", "packed", "size"))):
                text = pa.decompress(packed, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
                own = print_of(text)
                if before is None:
                    rows.append((doc_id, len(text), None, own, None, None, None))
                    extra.append(("first", part, text))
                else:
                    rows.append(row(doc_id, text, own, before[1], before[2]))
                    extra.append((None, part, None))
                before = doc_id, text, own
            yield record(rows, extra)
        if before:
            yield record([(before[0], len(before[1]), None, before[2], None, None, None)], [("last", part, before[1])])

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            packed = [pa.compress(t, codec="zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "tie", "size", "packed"])

    parts = max(8, 2 * docs.rdd.getNumPartitions())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.mapInArrow(pack, "doc_id bigint, tie bigint, size bigint, packed binary").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "tie")
    done = materialise(dealt.mapInArrow(ranges, f"{schema}, kind string, part int, text string"), "fingerprints")
    filled = sorted(r["part"] for r in done.filter("kind = 'last'").select("part").collect())  # as many as partitions
    if not filled:
        return done.select(*names)
    previous = spark.createDataFrame(list(zip(filled, [filled[-1], *filled[:-1]])), "part int, of int")
    first = done.filter("kind = 'first'").join(F.broadcast(previous), "part").select("doc_id", "fingerprint", "text", F.col("of").alias("part"))
    last = done.filter("kind = 'last'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("following_print"))

    def ends(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield record([row(i, t, own, f, fp) for i, own, t, f, fp in zip(*(c.to_pylist() for c in b.columns))])

    edges = first.join(last, "part").select("doc_id", "fingerprint", "text", "following", "following_print").mapInArrow(ends, schema)
    return done.filter(F.col("kind").isNull()).select(*names).unionByName(edges)
