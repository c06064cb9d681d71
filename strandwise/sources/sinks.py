"""Writers: FASTA, FASTQ, SAM, VCF text, split reads, and the plan of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg
from strandwise.functions.flags import has, none_of
from strandwise.functions.sequence import reverse_complement, wrap


def polished_name(name: Column, task: int) -> Column:
    """The name after a task: its digit is added to the suffix."""
    suffixed = name.rlike(r"_np[0-9]+$")
    return F.when(suffixed, F.concat(name, F.lit(str(task)))).otherwise(F.concat(name, F.lit(f"_np{task}")))


def write_fasta(contigs: DataFrame, path: str, width: int | None = None, least: int = 0) -> None:
    """contigs(name, seq) as '>name len' records. Sequences of least bases or fewer are an error, as of a failed task."""
    seq = F.when(F.length("seq") > least, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no consensus of "), "name")).cast("string")) if least else F.col("seq")
    body = wrap(seq, width) if width else seq
    contigs.select(F.concat(F.lit(">"), "name", F.lit(" "), F.length("seq").cast("string"), F.lit("\n"), body)).write.text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """reads(name, seq, qual) with qual as text."""
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.repeat(F.lit("B"), F.length("seq"))))).write.text(path)


def sam_lines(aln: DataFrame) -> DataFrame:
    """aln (the columns of the SAM reader) -> value: lines of SAM."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    one_based = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    qual = F.coalesce(F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""), F.lit("*"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"]))
    rnext = F.when(F.col("rnext") == F.col("rname"), "=").otherwise(star("rnext"))
    fields = [star("qname"), F.col("flag").cast("string"), star("rname"), one_based("pos"), F.coalesce("mapq", F.lit(0)).cast("string"), cg.text(F.col("cigar")), rnext, one_based("pnext"), F.coalesce("tlen", F.lit(0)).cast("string"), star("seq"), qual]
    return aln.select(F.concat_ws("\t", *fields, tags).alias("value"))


def export_reads(aln: DataFrame, require: int = 0, exclude: int = 0x900) -> DataFrame:
    """aln(qname, flag, seq, qual text) -> name, end (1, 2, or 0), seq, qual as sequenced: reverse records are turned."""
    f = F.col("flag")
    rev = has(f, "REVERSE")
    rows = aln.filter(none_of(f, exclude) & (f.bitwiseAND(F.lit(require)) == require))
    end = F.when(has(f, "READ1") & ~has(f, "READ2"), 1).when(has(f, "READ2") & ~has(f, "READ1"), 2).otherwise(0)
    return rows.select(F.col("qname").alias("name"), end.alias("end"), F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def write_parts(reads: DataFrame, path: str, column: str = "part") -> None:
    """reads(name, seq, part) as gzip FASTA, a folder for each part."""
    reads.select(column, F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.partitionBy(column).option("compression", "gzip").text(path)


def vcf_lines(variants: DataFrame) -> DataFrame:
    """variants (the columns of the VCF reader) -> value: lines of VCF."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    qual = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string"))
    fields = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alt", ",")), dot(qual), dot(F.array_join("filter", ";")), F.when(info == "", ".").otherwise(info), F.array_join("format", ":")]
    return variants.select(F.concat_ws("\t", *fields, F.transform("samples", lambda s: F.array_join(s, ":"))).alias("value"))


def to_paf(aln: DataFrame, lengths: DataFrame) -> DataFrame:
    """aln(qname, flag, rname, pos, mapq, cigar, tags), lengths(rname, tlen) -> PAF columns of the mapped records. Matches
    are the M, = and X bases less the mismatches that the NM tag leaves after gaps; clips give the query's place."""
    f, c = F.col("flag"), F.col("cigar")
    rev, gaps, aligned = has(f, "REVERSE"), cg.total(c, ("I", "D")), cg.total(c, ("M", "=", "X"))
    left, right, inner = cg.all_clips(c, False), cg.all_clips(c, True), cg.total(c, ("M", "=", "X", "I"))
    beg = F.when(rev, right).otherwise(left).cast("long")
    mismatches = F.greatest(F.coalesce(F.try_element_at("tags", F.lit("NM")).cast("long"), gaps) - gaps, F.lit(0))
    rows = aln.filter(none_of(f, 4)).join(lengths, "rname")
    return rows.select(
        "qname", (left + right + inner).cast("long").alias("qlen"), beg.alias("qbeg"), (beg + inner).alias("qend"), F.when(rev, "-").otherwise("+").alias("strand"), F.col("rname").alias("tname"), "tlen",
        F.col("pos").cast("long").alias("tbeg"), (F.col("pos") + cg.reference_span(c)).cast("long").alias("tend"), (aligned - mismatches).alias("matches"), (aligned + gaps).alias("columns"), "mapq",
    )


def paf_lines(df: DataFrame) -> DataFrame:
    """The columns of PAF -> value: its lines."""
    names = ("qname", "qlen", "qbeg", "qend", "strand", "tname", "tlen", "tbeg", "tend", "matches", "columns", "mapq")
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value"))
