"""BAM: blocks of gzip, records in binary. Read as a Spark data source whose partitions begin at block starts, and
written by the same layout. Local and mounted paths only; other stores go through Parquet or SAM text."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Letters by code.
NT16, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=XB"
SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar array<struct<op:string,len:int>>, rnext string, pnext long, tlen long, seq string, qual array<short>, tags map<string,string>"
#: Fixed value: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def blocks(data: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """Where each block begins, and its size."""
    while at + 18 <= len(data):
        extra = struct.unpack_from("<H", data, at + 10)[0]
        p, stop, size = at + 12, at + 12 + extra, 0
        while p + 4 <= stop:
            a, b, n = data[p], data[p + 1], struct.unpack_from("<H", data, p + 2)[0]
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", data, p + 4)[0] + 1
            p += 4 + n
        if not size:
            raise ValueError("not a block-gzip file")
        yield at, size
        at += size


def inflate(data: bytes, at: int, size: int) -> bytes:
    extra = struct.unpack_from("<H", data, at + 10)[0]
    return zlib.decompress(data[at + 12 + extra : at + size - 8], -15)


def deflate(data: bytes) -> bytes:
    """data as blocks, without the end."""
    out = []
    for i in range(0, len(data), 0xFF00):
        part = data[i : i + 0xFF00]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def read_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """The text, (name, len) of each contig, and where the records begin."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text, p = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    count, p = struct.unpack_from("<i", data, p)[0], p + 4
    names = []
    for _ in range(count):
        k = struct.unpack_from("<i", data, p)[0]
        names.append((data[p + 4 : p + 3 + k].decode(), struct.unpack_from("<i", data, p + 4 + k)[0]))
        p += 8 + k
    return text, names, p


#: Struct codes of the tags' number types.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def read_tags(data: bytes) -> dict[str, str]:
    out, p = {}, 0
    while p + 3 <= len(data):
        key, kind = data[p : p + 2].decode(), chr(data[p + 2])
        p += 3
        if kind == "A":
            out[key], p = chr(data[p]), p + 1
        elif kind in NUMBERS:
            code = "<" + NUMBERS[kind]
            out[key], p = f"{struct.unpack_from(code, data, p)[0]:g}" if kind == "f" else str(struct.unpack_from(code, data, p)[0]), p + struct.calcsize(code)
        elif kind in "ZH":
            end = data.index(0, p)
            out[key], p = data[p:end].decode(), end + 1
        elif kind == "B":
            code, n = NUMBERS[chr(data[p])], struct.unpack_from("<i", data, p + 1)[0]
            values = struct.unpack_from(f"<{n}{code}", data, p + 5)
            out[key], p = ",".join([chr(data[p]), *(f"{v:g}" for v in values)]), p + 5 + n * struct.calcsize(code)
        else:
            raise ValueError(f"a tag of type {kind}")
    return out


def read_record(data: bytes, names: list[tuple[str, int]]) -> tuple:
    """One record without its size."""
    tid, pos, n_name, mapq, _, n_cigar, flag, n, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data, 0)
    p = 32 + n_name
    cigar = [(OPS[c & 15], c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", data, p)]
    p += 4 * n_cigar
    packed, p = data[p : p + (n + 1) // 2], p + (n + 1) // 2
    seq = "".join(NT16[b >> 4] + NT16[b & 15] for b in packed)[:n]
    qual = data[p : p + n]
    name = lambda t: names[t][0] if t >= 0 else None
    qname = data[32 : 31 + n_name].decode()
    return (None if qname == "*" else qname, flag, name(tid), pos if pos >= 0 else None, mapq, cigar or None, name(mtid), mpos if mpos >= 0 else None, tlen, seq or None, None if not n or qual[0] == 255 else list(qual), read_tags(data[p + n :]))


def write_record(row, ids: dict[str, int]) -> bytes:
    """A row of SCHEMA with its size; tags are written as text."""
    qname = (row["qname"] or "*").encode() + b"\0"
    cigar = row["cigar"] or []
    seq = row["seq"] or ""
    codes = [NT16.index(b) if b in NT16 else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(row["qual"]) if row["qual"] is not None else b"\xff" * len(seq)
    tags = b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in sorted((row["tags"] or {}).items()))
    none = lambda v: -1 if v is None else v
    beg = none(row["pos"])
    end = beg + max(1, sum(c["len"] for c in cigar if c["op"] in "MDN=X"))
    bin_ = next((first + (beg >> s) for s, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if beg >> s == (end - 1) >> s), 0)
    body = struct.pack("<iiBBHHHiiii", ids.get(row["rname"], -1), beg, len(qname), row["mapq"] or 0, bin_ & 0xFFFF, len(cigar), row["flag"] or 0, len(seq), ids.get(row["rnext"], -1), none(row["pnext"]), row["tlen"] or 0)
    body += qname + b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def write_bam(rows: Iterator, targets: list[tuple[str, int]], path: str, text: str = "") -> None:
    """Rows of SCHEMA in order, as one file."""
    text = text or "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in targets)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(targets))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in targets)
    ids = {n: i for i, (n, _) in enumerate(targets)}
    with open(path, "wb") as f:
        f.write(deflate(head))
        wait = bytearray()
        for row in rows:
            wait += write_record(row, ids)
            if len(wait) > 0xFF00:
                f.write(deflate(bytes(wait)))
                wait.clear()
        f.write(deflate(bytes(wait)) + END)


def is_complete(path: str) -> bool:
    """Whether the file begins as BAM and ends with the empty block."""
    with open(path, "rb") as f:
        head = f.read(1 << 16)
        f.seek(max(0, os.path.getsize(path) - len(END)))
        tail = f.read()
    try:
        at, size = next(blocks(head))
        return inflate(head, at, size)[:4] == b"BAM\1" and tail == END
    except (StopIteration, ValueError, zlib.error):
        return False


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = sorted(p for x in path.split(",") for p in (glob.glob(x) or [x]))

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, part):
        with open(part.path, "rb") as f:
            data = f.read()
        wait, names, size = bytearray(), None, 0
        for at, n in blocks(data):
            wait += inflate(data, at, n)
            if names is None:
                try:
                    _, names, begin = read_header(bytes(wait))
                except (struct.error, IndexError):
                    continue
                del wait[:begin]
            p = 0
            while p + 4 <= len(wait) and p + 4 + (size := struct.unpack_from("<i", wait, p)[0]) <= len(wait):
                yield read_record(bytes(wait[p + 4 : p + 4 + size]), names)
                p += 4 + size
            del wait[:p]


class BamSource(DataSource):
    """spark.read.format("bam").load(path): a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)
