import math

import pytest
from pyspark.sql import functions as F
from strandwise.functions import cigar as cg
from strandwise.functions import flags as fl
from strandwise.functions import sequence as sq
from strandwise.functions import special


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0][0]


def test_sequences(spark):
    s = F.col("s")
    assert one(spark, sq.reverse_complement(s), s="ACGTNacgt") == "acgtNACGT"
    assert one(spark, sq.homopolymer_compress(s), s="AACCCGTT") == "ACGT"
    assert one(spark, sq.kmers(s, 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, sq.kmers(s, 6), s="ACGTA") == []
    assert one(spark, sq.kmer_code(s), s="ACGT") == 0b00011011
    assert one(spark, sq.kmer_code(s), s="ACNT") is None
    assert one(spark, sq.wrap(s, 4), s="ACGTACGTAC") == "ACGT\nACGT\nAC"
    assert one(spark, sq.wrap(s, 5), s="ACGTACGTAC") == "ACGTA\nCGTAC"
    assert [tuple(r) for r in one(spark, sq.soft_mask_runs(s), s="acGTTaA")] == [(0, 2), (5, 6)]
    assert one(spark, sq.gc_count(s), s="GgCcAT") == 4
    assert one(spark, sq.code_of(s, sq.NT16), s="N") == 15
    assert one(spark, sq.code_of(s, sq.CONSENSUS), s="-") == 4
    assert one(spark, sq.base_of(F.lit(8), sq.NT16)) == "T"


def test_natural_order(spark):
    names = ["chr10", "chr2", "chr2a", "chr002b", "chr1", "x"]
    df = spark.createDataFrame([(n,) for n in names], ["n"])
    assert [r[0] for r in df.orderBy(sq.natural_key(F.col("n"))).collect()] == ["chr1", "chr2", "chr2a", "chr002b", "chr10", "x"]


def test_invertible_hash_is_one_to_one(spark):
    df = spark.range(1 << 10).select(sq.invertible_hash(F.col("id"), 10).alias("h"))
    assert df.distinct().count() == 1 << 10
    assert spark.range(5).select(sq.invertible_hash(F.col("id") + (1 << 41), 42).alias("h")).distinct().count() == 5


def test_cigars(spark):
    c = cg.parse(F.col("s"))
    at = lambda column, s: one(spark, column, s=s)
    text = "5H3S10M2I4M3D6N7M2S"
    assert at(cg.text(c), text) == text
    assert at(cg.text(c), "*") == "*"
    assert at(cg.reference_span(c), text) == 10 + 4 + 3 + 6 + 7
    assert at(cg.query_span(c), text) == 3 + 10 + 2 + 4 + 7 + 2
    assert at(cg.query_span(c, hard=True), text) == 33
    assert at(cg.clip_length(c, False), text) == 5 and at(cg.clip_length(c, True), text) == 2
    assert at(cg.unclipped_start(F.lit(100), c), text) == 92
    assert at(cg.unclipped_end(F.lit(100), c), text) == 132
    assert at(cg.clip_ratio(c, F.lit(28)), "3S20M5S") == 8 / 28
    assert at(cg.interval_bin(F.lit(0), F.lit(1 << 14)), "1M") == 4681
    assert at(cg.interval_bin(F.lit(0), F.lit((1 << 14) + 1)), "1M") == 585
    assert [(r.op, r.q, r.r) for r in at(cg.with_offsets(c), "2S3M1I2M")] == [("S", 0, 0), ("M", 2, 0), ("I", 5, 3), ("M", 6, 3)]


def test_trimming_stops_outside_of_runs(spark):
    seq, cigar = F.col("s"), cg.parse(F.col("c"))
    beg, end = cg.trimmed_span(seq, cigar, 2)
    got = spark.createDataFrame([("ACGGGTACGTTTCA", "14M")], ["s", "c"]).select(beg, end).collect()[0]
    assert (got[0], got[1]) == (2, 12)
    got = spark.createDataFrame([("AGGGTACGTTTA", "12M")], ["s", "c"]).select(beg, end).collect()[0]
    assert got[0] == 4 and got[1] == 8


def test_flags(spark):
    f = F.col("f")
    assert one(spark, fl.to_text(f), f=99) == "PAIRED,PROPER_PAIR,MREVERSE,READ1"
    assert one(spark, fl.from_text(fl.to_text(f)), f=3933) == 3933
    assert one(spark, fl.short_first(f), f=0x400) is False
    keep = fl.view(f, F.lit(30), F.lit(100), all_of=1, none=4, not_all=0x30, min_mapq=30)
    assert one(spark, keep, f=1) and not one(spark, keep, f=0x31) and not one(spark, keep, f=5)


def test_special_functions(spark):
    assert special.gamma_lower(1, 2) == pytest.approx(1 - math.exp(-2))
    assert special.gamma_upper(3, 5) == pytest.approx(math.exp(-5) * (1 + 5 + 12.5))
    assert special.beta_regularised(2, 3, 0.4) == pytest.approx(0.5248)
    left, right, two = special.fisher(3, 1, 1, 3)
    assert (left, right, two) == pytest.approx((69 / 70, 17 / 70, 34 / 70))
    df = spark.createDataFrame([(0.5,), (None,)], "x double")
    assert df.select(special.erfc(F.col("x"))).collect()[1][0] is None
