import gzip

import pytest
from pyspark.sql import functions as F
from strandwise.sources import bam as bm
from strandwise.sources import sinks
from strandwise.sources import text as tx

from tests.conftest import rows

SAM = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:1000\n@SQ\tSN:c2\tLN:500\n@RG\tID:g\tSM:s\nr1\t99\tc1\t11\t60\t3S5M\t=\t31\t30\tACGTACGT\tIIIIIIII\tNM:i:1\tSA:Z:c2,5,-,5M,9,0;\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text) if isinstance(text, str) else p.write_bytes(text)
    return str(p)


def test_fasta(spark, tmp_path):
    p = write(tmp_path, "a.fa", ">one first seq\nACGT\nAC GT\n\n>two\n>three x\nTT\r\n")
    assert rows(tx.fasta(spark, p)) == [("one", "first seq", "ACGTACGT"), ("three", "x", "TT"), ("two", "", "")]


def test_fastq_with_odd_lines(spark, tmp_path):
    text = "@a c\nACGT\nAC\n+a\n@@@@\n@+\n>f\nGG\nTT\n@b\nA\n+\nI\n"
    p = write(tmp_path, "a.fq.gz", gzip.compress(text.encode()))
    assert [tuple(r) for r in tx.fastq(spark, p).collect()] == [("a", "c", "ACGTAC", "@@@@@+"), ("f", "", "GGTT", None), ("b", "", "A", "I")]
    with pytest.raises(ValueError):
        list(tx.parse_records(["@a", "ACG", "+", "II"]))


def test_sam_there_and_back(spark, tmp_path):
    p = write(tmp_path, "a.sam", SAM)
    df = tx.sam(spark, p)
    r = {x.qname: x for x in df.collect()}
    assert (r["r1"].pos, r["r1"].rnext, r["r1"].pnext, r["r1"].qual[0], r["r1"].tags["NM"]) == (10, "c1", 30, 40, "1")
    assert r["r2"].pos is None and r["r2"].cigar is None and r["r2"].seq is None
    lines = sorted(x.value for x in sinks.sam_lines(df).collect())
    assert lines[0].split("\t")[:11] == SAM.split("\n")[4].split("\t")[:11]
    assert lines[1] == SAM.split("\n")[5]
    header = tx.sam_header(spark, p)
    assert rows(tx.targets(header)) == [("c1", 1000), ("c2", 500)]
    part = df.filter("qname = 'r1'").select(F.explode(tx.supplementary_parts(F.col("tags")["SA"])).alias("p")).select("p.*").collect()[0]
    assert (part.rname, part.pos, part.strand, part.mapq) == ("c2", 4, "-", 9)


def test_bam_there_and_back(spark, tmp_path):
    df = tx.sam(spark, write(tmp_path, "a.sam", SAM))
    p = str(tmp_path / "a.bam")
    bm.write_bam(iter(df.collect()), [("c1", 1000), ("c2", 500)], p)
    assert bm.is_complete(p) and tx.sniff(open(p, "rb").read(4096)) == "bgzf:bam"
    a, b = (sorted((str(r) for r in x.collect())) for x in (df, bm.bam(spark, p)))
    assert a == b
    open(p, "r+b").truncate(200)
    assert not bm.is_complete(p)


def test_vcf_bed_and_tables(spark, tmp_path):
    v = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nc1\t5\t.\tA\tC,G\t30\tPASS\tDP=3;DB\tGT:GQ\t0/1:9\n"
    df = tx.vcf(spark, write(tmp_path, "a.vcf", v))
    r = df.collect()[0]
    assert (r.id, r.alt, r.info["DP"], r.info["DB"], r.samples) == (None, ["C", "G"], "3", "", [["0/1", "9"]])
    assert sinks.vcf_lines(df).collect()[0].value == "c1\t5\t.\tA\tC,G\t30\tPASS\tDB;DP=3\tGT:GQ\t0/1:9"
    assert rows(tx.indexed_table(spark, write(tmp_path, "b.vcf", v), "vcf").select("name", "beg", "end")) == [("c1", 4, 5)]
    b = tx.bed(spark, write(tmp_path, "a.bed", "track x\nc1\t5\t9\tn\nc2 7\n#\n"))
    assert rows(b) == [("c1", 5, 9), ("c2", 6, 7)]
    s = tx.indexed_table(spark, write(tmp_path, "b.sam", SAM), "sam").filter("name = 'c1'")
    assert rows(s.select("beg", "end")) == [(10, 15)]


def test_lists_settings_and_sniffing(spark, tmp_path):
    p = write(tmp_path, "l.fofn", "a.fq\n# no\n/b/c.fq # yes\n")
    assert tx.file_list(spark, p) == [f"{tmp_path}/a.fq", "/b/c.fq"]
    assert [tx.number_with_unit(x) for x in ("2G", "1.5k", "2 kb", "7")] == [2_000_000_000, 1500, 2000, 7]
    assert tx.settings("[x]\na = 1 # c\nb: two\n#d=3\n") == {"a": "1", "b": "two"}
    assert [tx.sniff(x) for x in (b">a\nAC", b"@a\nAC\n+", b"@SQ\tSN:a", b"c\t1\t5\n", b"##fileformat=VCFv4", b"\0\1", b"", gzip.compress(b">x\nA"))] == ["fasta", "fastq", "sam", "bed", "vcf", "unknown", "unknown", "gzip:fasta"]


def test_fasta_sink_and_exports(spark, tmp_path):
    c = spark.createDataFrame([("ctg", "ACGTAC")], "name string, seq string")
    sinks.write_fasta(c, str(tmp_path / "out"), width=4)
    assert rows(tx.fasta(spark, str(tmp_path / "out"))) == [("ctg", "6", "ACGTAC")]
    with pytest.raises(Exception, match="no consensus"):
        sinks.write_fasta(c, str(tmp_path / "bad"), least=10)
    names = spark.createDataFrame([("a",), ("a_np1",)], ["n"]).select(sinks.polished_name(F.col("n"), 2))
    assert rows(names) == [("a_np12",), ("a_np2",)]
    r = spark.createDataFrame([("q", 0x51, "AACG", "1234"), ("q", 0x900, "A", "1")], "qname string, flag int, seq string, qual string")
    assert rows(sinks.export_reads(r)) == [("q", 1, "CGTT", "4321")]
