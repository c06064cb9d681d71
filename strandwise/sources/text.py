"""Text formats by Spark's own readers: FASTA, FASTQ, SAM, VCF, BED, tab-separated presets, lists of files, settings.

Files may be compressed as Spark's codecs allow and lie wherever Spark reads. Where a format says nothing of order, rows
have none; read ids come from the place in the file where a reader needs them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, comment, seq. Records are split at '>' by the reader itself, so a large file is read in parallel; a '>'
    within a name line isn't supported. Blank lines and spaces in sequences go."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head, body = F.substring_index("value", "\n", 1), F.regexp_replace("value", r"^[^\n]*\n?", "")
    clean = F.regexp_replace(head, r"\r$", "")
    return raw.select(F.regexp_extract(clean, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(clean, r"^\S*", "")).alias("comment"), F.regexp_replace(body, r"\s", "").alias("seq")).filter("name <> '' or seq <> ''")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, comment, seq, qual, of records on four or more lines; FASTA records in the same file have a null qual. A
    quality shorter than its sequence is an error. A file is read by one task, as a '@' may begin a quality line."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")

    def records(frames):
        import gzip

        for pdf in frames:
            for content in pdf["content"]:
                text = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = list(parse_records(text.decode("utf-8", "replace").splitlines()))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["name", "comment", "seq", "qual"])

    return files.mapInPandas(records, "name string, comment string, seq string, qual string")


def parse_records(lines):
    """(name, comment, seq, qual or None) of FASTA and FASTQ lines, sequences on any number of lines."""
    i, n = 0, len(lines)
    while i < n:
        if not lines[i] or lines[i][0] not in ">@":
            i += 1
            continue
        name, _, comment = lines[i][1:].strip().partition(" ")
        i += 1
        seq = []
        while i < n and lines[i][:1] not in (">", "@", "+"):
            seq.append("".join(lines[i].split()))
            i += 1
        s, qual = "".join(seq), None
        if i < n and lines[i].startswith("+"):
            i += 1
            q, have = [], 0
            while i < n and have < len(s):
                q.append(lines[i].strip("\r\n"))
                have += len(q[-1])
                i += 1
            qual = "".join(q)
            if len(qual) != len(s):
                raise ValueError(f"the quality of {name} is not as long as its sequence")
        yield name, comment.strip(), s, qual


def quality_values(qual: Column, offset: int = 33) -> Column:
    """Array of the numbers that a quality string stands for."""
    return F.transform(F.regexp_extract_all(qual, F.lit("(.)"), F.lit(1)), lambda c: (F.ascii(c) - offset).cast("short"))


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """qname, flag, rname, pos (0-based), mapq, cigar, rnext, pnext (0-based), tlen, seq, qual (numbers), tags (map).
    '*' and position 0 become null; '=' becomes the record's own contig."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    star = lambda c: F.when(c != "*", c)
    place = lambda c: F.when(c.cast("long") > 0, c.cast("long") - 1)
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v"))
    rows = lines.select(f.alias("f"))
    rname = star(F.col("f")[2])
    return rows.select(
        star(F.col("f")[0]).alias("qname"), F.col("f")[1].cast("int").alias("flag"), rname.alias("rname"), place(F.col("f")[3]).alias("pos"), F.col("f")[4].cast("int").alias("mapq"), cg.parse(F.col("f")[5]).alias("cigar"),
        F.when(F.col("f")[6] == "=", rname).otherwise(star(F.col("f")[6])).alias("rnext"), place(F.col("f")[7]).alias("pnext"), F.col("f")[8].cast("long").alias("tlen"), star(F.col("f")[9]).alias("seq"), quality_values(star(F.col("f")[10])).alias("qual"),
        F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), tag)).alias("tags"),
    )


def sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """kind (SQ, RG, ...), fields (map) of the header lines; @CO has its text under ''."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@"))
    kind = F.substring("value", 2, 2)
    rest = F.split(F.expr("substring(value, 5)"), "\t")
    pairs = F.transform(F.filter(rest, lambda x: F.length(x) > 3), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:", "").alias("v")))
    return lines.select(kind.alias("kind"), F.when(kind == "CO", F.create_map(F.lit(""), F.expr("substring(value, 5)"))).otherwise(F.map_from_entries(pairs)).alias("fields"))


def targets(header: DataFrame) -> DataFrame:
    """name, len of the header's contigs."""
    return header.filter("kind = 'SQ'").select(F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("long").alias("len"))


def supplementary_parts(sa: Column) -> Column:
    """The SA tag's alignments: array of (rname, pos, strand, cigar, mapq, nm)."""
    one = lambda x: F.split(x, ",")
    parts = F.filter(F.split(sa, ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(one(x)[0].alias("rname"), (one(x)[1].cast("long") - 1).alias("pos"), one(x)[2].alias("strand"), cg.parse(one(x)[3]).alias("cigar"), one(x)[4].cast("int").alias("mapq"), one(x)[5].cast("int").alias("nm")))


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt (array), qual, filter (array), info (map; flags have ''), format (array),
    samples (array of arrays)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    dot = lambda c: F.when(c != ".", c)
    rows = lines.select(f.alias("f"))
    info = F.map_from_entries(F.transform(F.filter(F.split(F.col("f")[7], ";"), lambda x: (x != ".") & (x != "")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v"))))
    col = F.col("f")
    return rows.select(
        col[0].alias("chrom"), col[1].cast("long").alias("pos"), dot(col[2]).alias("id"), col[3].alias("ref"), F.split(dot(col[4]), ",").alias("alt"), dot(col[5]).cast("double").alias("qual"), F.split(dot(col[6]), ";").alias("filter"), info.alias("info"),
        F.when(F.size("f") > 8, F.split(F.try_element_at("f", F.lit(9)), ":")).alias("format"), F.transform(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))), lambda s: F.split(s, ":")).alias("samples"),
    )


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, beg, end (0-based, half-open). Lines of two columns are a 1-based position; track and comment lines go."""
    lines = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    f = F.split(F.trim("value"), r"\s+")
    two = F.size(f) == 2
    return lines.select(f[0].alias("chrom"), F.when(two, f[1].cast("long") - 1).otherwise(f[1].cast("long")).alias("beg"), F.when(two, f[1].cast("long")).otherwise(F.try_element_at(f, F.lit(3)).cast("long")).alias("end"))


#: Columns (from 1) of name, begin and end, whether begins count from 0, and the comment sign.
PRESETS = {"gff": (1, 4, 5, False, "#"), "bed": (1, 2, 3, True, "#"), "sam": (3, 4, 0, False, "@"), "vcf": (1, 2, 0, False, "#"), "psltbl": (15, 17, 18, True, "#")}


#: The first twelve columns of the pairwise mapping format, and their types.
PAF = "qname string, qlen long, qbeg long, qend long, strand string, tname string, tlen long, tbeg long, tend long, matches long, columns long, mapq int"


def paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of PAF, and tags: a map of the others by their names."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).filter("value <> ''").select(f.alias("f"))
    typed = [F.get("f", F.lit(i)).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(PAF.split(", "))]
    tags = F.transform(F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:.:", "").alias("v")))
    return rows.select(*typed, F.map_from_entries(tags).alias("tags"))


def indexed_table(spark: SparkSession, path: str | list[str], preset: str, skip: int = 0) -> DataFrame:
    """name, beg, end (0-based, half-open), line of a tab-separated file by one of the presets."""
    name, beg, end, zero, comment = PRESETS[preset]
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.col("value") != ""))
    f = F.split("value", "\t")
    b = f[beg - 1].cast("long") - (0 if zero else 1)
    span = {"sam": F.greatest(cg.reference_span(cg.parse(f[5])), F.lit(1)), "vcf": F.length(f[3])}.get(preset)
    e = b + F.coalesce(span, F.lit(1)) if span is not None else f[end - 1].cast("long") if end else b + 1
    return lines.select(f[name - 1].alias("name"), b.alias("beg"), e.cast("long").alias("end"), F.col("value").alias("line"))


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths of a list, one a line, without comments; relative ones are in the list's folder. A list is small."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    lines = [r[0].split("#", 1)[0].strip() for r in spark.read.text(path).collect()]
    return [x if "://" in x or x.startswith("/") else f"{folder}/{x}" for x in lines if x]


def settings(text: str) -> dict[str, str]:
    """key = value lines of a settings file; sections and comments are passed over, later keys win."""
    found = re.findall(r"^\s*([^\s#;\[=]+)\s*[=:]\s*(.*?)\s*(?:#.*)?$", text, re.M)
    return dict(found)


def number_with_unit(text: str, base: int = 1000) -> int:
    """'2G', '1.5k', '2 kb' -> a whole number, rounded."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([kmgt]?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"no number: {text}")
    return int(float(m[1]) * base ** ("kmgt".index(m[2]) + 1 if m[2] else 0) + 0.499)


def truth(text: str) -> bool:
    return text.strip().lower() not in ("no", "0", "false", "")


def sniff(head: bytes) -> str:
    """The format of a file by its first bytes."""
    import zlib

    if head[:2] == b"\x1f\x8b":
        blocks = head[3] & 4 and head[12:14] == b"BC"
        try:
            inner = zlib.decompressobj(31).decompress(head)
        except zlib.error:
            inner = b""
        return ("bgzf:" if blocks else "gzip:") + sniff(inner)
    for magic, name in ((b"BAM\1", "bam"), (b"CRAM", "cram"), (b"BCF\2", "bcf"), (b"BAI\1", "bai"), (b"CSI\1", "csi"), (b"TBI\1", "tbi"), (b"##fileformat=VCF", "vcf"), (b">", "fasta")):
        if head.startswith(magic):
            return name
    if re.match(rb"@(HD|SQ|RG|PG|CO)\t", head):
        return "sam"
    if head[:1] == b"@":
        return "fastq"
    first = head.split(b"\n", 1)[0].split(b"\t")
    if len(first) >= 11 and first[1].isdigit() and first[3].isdigit():
        return "sam"
    if len(first) >= 3 and first[1].isdigit() and first[2].strip().isdigit():
        return "bed"
    return "text" if head and not re.search(rb"[\x00-\x08]", head) else "unknown"
