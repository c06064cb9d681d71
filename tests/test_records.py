import random
import re

from pyspark.sql import functions as F
from strandwise.functions import cigar as cg
from strandwise.functions import pairs as pr
from strandwise.operators import splits, variants
from strandwise.sources import sinks, text

from tests.conftest import rows

COMP = str.maketrans("ACGT", "TGCA")


def random_alignments(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ops, q, t = [], "", ""
        for op in ["M", *r.choices("MID", k=6), "M"]:
            if ops and ops[-1][0] == op:
                continue
            k = r.randrange(1, 9)
            ops.append((op, k))
            for _ in range(k):
                a = r.choice("ACGT")
                q += "-" if op == "D" else a
                t += "-" if op == "I" else r.choice(a * 4 + "ACGT") if op == "M" else a
        clip = r.randrange(3)
        seq = "N" * clip + q.replace("-", "")
        out.append((i, r.randrange(50), (f"{clip}S" if clip else "") + "".join(f"{k}{op}" for op, k in ops), seq, t.replace("-", ""), q, t))
    return out


def frame(spark, cases):
    df = spark.createDataFrame(cases, "i int, pos bigint, c string, seq string, ref string, q string, t string")
    return df.withColumn("cigar", cg.parse(F.col("c"))).withColumn("p", pr.gapped(F.col("cigar"), F.col("seq"), F.col("ref")))


def test_pairs_and_difference_strings(spark):
    cases = random_alignments(60)
    df = frame(spark, cases)
    for (i, _, _, _, ref, q, t), row in zip(cases, df.select("i", "p", pr.md(F.col("p")).alias("md"), pr.cs(F.col("p")).alias("cs"), pr.differences(F.col("p")).alias("nm")).orderBy("i").collect()):
        assert (row.p.q, row.p.t) == (q, t)
        assert row.nm == sum(a != b for a, b in zip(q, t))
        back, read = "", q.replace("-", "")  # the target from the read and MD, the insertions left out
        shown = "".join(a for a, b in zip(q, t) if b != "-")
        for n, base, gone in re.findall(r"(\d+)|([A-Z])(?![A-Z]*\^)|\^([A-Z]+)", re.sub(r"(\^[A-Z]+)", lambda m: m[0], row.md)):
            if n:
                back += shown[len(back) : len(back) + int(n)]
            else:
                back += base or gone
        assert back == ref
        a = b = ""
        for k, v in re.findall(r"([:*+-])([0-9a-z]+)", row.cs):
            piece = read[len(a) : len(a) + int(v)] if k == ":" else ""
            a += piece + (v.upper() if k == "+" else v[1].upper() if k == "*" else "")
            b += piece + (v.upper() if k == "-" else v[0].upper() if k == "*" else "")
        assert (a, b) == (read, ref)


def test_empty_pair(spark):
    df = frame(spark, [(0, 0, "*", "", "", "", ""), (1, 0, "3S", "ACG", "", "", "")])
    got = df.select(pr.identity(F.col("p")), pr.exact_ends(F.col("p"), 2, 1)).collect()
    assert all(x is None for row in got for x in row)


def test_exact_ends(spark):
    q, t = "TTACGTACGTT-ACGTACGTAG", "TAACGTACGTTAACGTACGTAC"
    df = spark.createDataFrame([(q, t)], "q string, t string").select(F.struct("q", "t").alias("p"))
    e = df.select(pr.exact_ends(F.col("p"), 8, 10).alias("e"), pr.exact_ends(F.col("p"), 8, 30).alias("none")).first()
    assert (e.e.q, e.e.t, e.e.skipped) == (q[2:-1], t[2:-1], 2) and e.none is None


def test_clip_to_window(spark):
    cases = random_alignments(40, 2)
    df = frame(spark, cases)
    for beg, end in ((0, 1000), (40, 55), (52, 53), (900, 901)):
        got = {r.i: r.w for r in df.select("i", pr.clip_to_window(F.col("pos"), F.col("cigar"), F.lit(beg), F.lit(end)).alias("w")).collect()}
        for i, pos, c, _, _, q, t in cases:
            at, qi, kept = pos - 1, c.count("S") and int(c.split("S")[0]), []
            for a, b in zip(q, t):
                at += b != "-"
                if beg <= at < end:
                    kept.append((at, qi, "I" if b == "-" else "D" if a == "-" else "M"))
                qi += a != "-"
            shown = "".join(x.op * x.len for x in got[i].cigar)
            assert shown == "".join(k[2] for k in kept)
            if kept and kept[0][2] != "I":
                assert (got[i].pos, got[i].qbeg) == kept[0][:2]


def test_depad(spark):
    padded = "AC**GT*A"
    df = spark.createDataFrame([(0, "8M"), (1, "1M2D2M2D"), (4, "2S2M1D1M"), (0, "2M2N4M")], "pos bigint, c string")
    out = df.select(pr.depad(F.col("pos"), cg.parse(F.col("c")), F.lit(padded)).alias("d")).select("d.pos", cg.text(F.col("d.cigar")))
    assert [tuple(r) for r in out.collect()] == [(0, "2M2I2M1I1M"), (1, "3M1D"), (2, "2S3M"), (0, "4M1I1M")]


def test_tags_and_template(spark):
    df = spark.createDataFrame([({"A": "1"},), (None,)], "t map<string,string>")
    assert [r[0] for r in df.select(pr.set_tag(F.col("t"), "B", F.lit(2))).collect()] == [{"A": "1", "B": "2"}, {"B": "2"}]
    assert [r[0] for r in df.select(pr.set_tag(F.col("t"), "A", F.lit(None))).collect()] == [{}, {}]
    m = lambda pos, flag, c: F.struct(F.lit(0).alias("tid"), F.lit(pos).alias("pos"), F.lit(flag).alias("flag"), cg.parse(F.lit(c)).alias("cigar"))
    one = spark.range(1)
    assert one.select(pr.template_cigar(m(30, 65 + 16, "2S5M"), m(10, 129, "5M1D4M"))).first()[0] == "2F5M1D4M10T1R2S5M"
    assert one.select(pr.template_cigar(m(30, 69, "5M"), m(10, 129, "5M"))).first()[0] is None


def test_packed(spark):
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 1, 30, 31, 32, 62, 200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("w", pr.pack(F.col("s")))
    assert [x[0] for x in df.select(pr.unpack(F.col("w"), F.length("s"))).collect()] == seqs
    n = F.length("s")
    got = df.filter(n >= 62).select(pr.packed_substring(F.col("w"), n, F.lit(29), F.lit(62)), pr.packed_substring(F.col("w"), n, F.lit(31), F.lit(60), F.lit(True))).collect()
    assert [tuple(x) for x in got] == [(s[29:62], s[31:60].translate(COMP)[::-1]) for s in seqs if len(s) >= 62]


def test_merge_mates(spark):
    r = random.Random(4)
    whole = "".join(r.choice("ACGT") for _ in range(60))
    turn = lambda s: s.translate(COMP)[::-1]
    df = spark.createDataFrame([(whole[:40], turn(whole[20:])), (whole[:20], turn(whole[40:])), (whole[:5], whole[:5])], "a string, b string")
    assert [x[0] for x in df.select(pr.merge_mates(F.col("a"), F.col("b"))).collect()] == [whole, None, None]


def test_clipped_mean(spark):
    r = random.Random(5)
    data = [(k, r.choice([0, 3, 5, 400, 1000]) + r.randrange(40)) for k in (1, 2) for _ in range(300)]

    def want(xs, start):
        mean = start
        while True:
            kept = [x for x in xs if 0 < x < 3 * mean]
            new = sum(kept) // len(kept) if kept else 0
            if new <= mean:
                return new
            mean = new

    df = spark.createDataFrame(data, "tid int, depth int")
    for start in (3, 20, 150):
        assert rows(splits.clipped_mean(df, start=start)) == [(k, want([d for t, d in data if t == k], start)) for k in (1, 2)]


def test_supported_clusters(spark):
    depth = spark.createDataFrame([(0, p, 4 if 20 <= p < 30 else 20) for p in range(100)], "tid bigint, pos bigint, depth bigint")
    clusters = spark.createDataFrame([(0, 20, 30, 2), (0, 21, 29, 0), (0, 60, 70, 50)], "tid bigint, beg bigint, end bigint, n bigint")
    assert rows(splits.supported_clusters(clusters, depth)) == [(0, 20, 30, 2, 4.0)]


def test_cut_contigs(spark):
    c = spark.createDataFrame([(1, "a", "ACGTACGT"), (2, "b", ""), (3, "c", "AC")], "tid bigint, contig string, seq string")
    p = spark.createDataFrame([(1, 3), (1, 3), (1, 5), (1, 0), (1, 8), (3, 9)], "tid bigint, point bigint")
    assert rows(splits.cut_contigs(c, p)) == [(1, "a_s0", "ACG"), (1, "a_s1", "TA"), (1, "a_s2", "CGT"), (2, "b", ""), (3, "c", "AC")]


def test_variant_edits(spark):
    v = spark.createDataFrame([(["C", "G", "T"], [["0/3", "9"], ["./2", "8"]]), (["C"], [["0", "1"], ["0|0", "2"]])], "alt array<string>, samples array<array<string>>")
    got = variants.trim_alleles(v).collect()
    assert [(r.alt, r.samples) for r in got] == [(["G", "T"], [["0/2", "9"], ["./1", "8"]]), ([], [["0", "1"], ["0|0", "2"]])]
    assert [r.samples for r in variants.subset_samples(v, [1]).collect()] == [[["./2", "8"]], [["0|0", "2"]]]
    assert [r.samples for r in variants.subset_samples(v, []).collect()] == [[], []]
    g = spark.createDataFrame([("0/0",), ("0|1",), ("1/1",), ("./1",), (None,), ("2",), ("1/2",)], "g string")
    assert [r[0] for r in g.select(variants.genotype_class(F.col("g"))).collect()] == ["hom_ref", "het", "hom_alt", "missing", "missing", "hom_alt", "het"]
    f = spark.createDataFrame([(None,), (["PASS"],), (["q10", "s50"],)], "f array<string>")
    assert [r[0] for r in f.select(variants.passes(F.col("f"), "PASS")).collect()] == [True, True, False]


def test_paf(spark, tmp_path):
    aln = spark.createDataFrame([("r1", 16, "c", 10, 60, "2S5M1I3M1D2M1H", {"NM": "4"}), ("r2", 4, "c", 0, 0, "*", {})], "qname string, flag int, rname string, pos bigint, mapq int, c string, tags map<string,string>")
    out = sinks.to_paf(aln.withColumn("cigar", cg.parse(F.col("c"))), spark.createDataFrame([("c", 100)], "rname string, tlen bigint"))
    assert [tuple(r) for r in out.collect()] == [("r1", 14, 1, 12, "-", "c", 100, 10, 21, 8, 12, 60)]
    sinks.paf_lines(out).withColumn("value", F.concat("value", F.lit("\ttp:A:P\tcg:Z:5M"))).write.text(str(tmp_path / "x.paf"))
    back = text.paf(spark, str(tmp_path / "x.paf")).first()
    assert tuple(back)[:12] == tuple(out.first()) and back.tags == {"tp": "P", "cg": "5M"}
