import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strandwise.operators import assembly, consensus, duplicates, ordering, pileup, ranges, regions, report, seeds, variants

from tests.conftest import rows


def intervals(spark, xs, extra=""):
    return spark.createDataFrame(xs, f"tid bigint, beg bigint, end bigint{extra}")


def test_interval_joins_against_brute_force(spark):
    r = random.Random(1)
    make = lambda n, w: [(r.randrange(2), a, a + r.randrange(0, w)) for a in (r.randrange(20000) for _ in range(n))]
    a, b = make(120, 9000), make(150, 60)
    touch = lambda x, y: x[0] == y[0] and x[1] < max(y[2], y[1] + 1) and max(x[2], x[1] + 1) > y[1]
    da, db = intervals(spark, a), intervals(spark, b)
    got = rows(ranges.overlap_join(da, db, width=512))
    assert got == sorted((*x, *y) for x in a for y in b if touch(x, y))
    assert rows(ranges.overlap_join(da, db, width=512, how="left_semi")) == sorted(x for x in a if any(touch(x, y) for y in b))
    assert rows(ranges.overlap_join(da, db, width=512, how="left_anti")) == sorted(x for x in a if not any(touch(x, y) for y in b))
    spans = lambda x, y: x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2]
    got = rows(ranges.contains_join(da, db, width=512))
    assert got == sorted((*x, *y) for x in a for y in b if spans(x, y) and max(x[2], x[1] + 1) > y[1])


def test_region_text(spark):
    df = spark.createDataFrame([("chr1:1,001-2,000",), ("chr1",), ("a:b:5",)], ["r"])
    assert [tuple(x[0]) for x in df.select(ranges.parse_region(F.col("r"))).collect()] == [("chr1", 1000, 2000), ("chr1", 0, None), ("a:b", 4, None)]


def test_merge_across_blocks(spark):
    xs = [(1, 65530, 65540), (1, 65541, 65600), (1, 70000, 140000), (1, 139999, 140001), (2, 0, 1)]
    assert rows(regions.merge_intervals(intervals(spark, xs), gap=1)) == [(1, 65530, 65600, 2), (1, 70000, 140001, 2), (2, 0, 1, 1)]


def test_split_regions(spark):
    good = spark.createDataFrame([(1, p) for p in (30, 31, 32, 33, 60)], "tid bigint, pos bigint")
    got = rows(regions.split_regions(intervals(spark, [(1, 0, 80), (1, 100, 120)]), good, longest=50))
    assert got == [(1, 0, 32), (1, 32, 60), (1, 60, 80), (1, 100, 120)]


def test_region_scan():
    flags = [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    bases = "ACGTACGTACGTACGTACGT"
    assert regions.scan_regions(list(range(20)), flags, bases, 2, 1, 0) == [(1, 3), (18, 20)]
    assert regions.scan_regions(list(range(20)), flags, bases, 2, 1, 1) == [(0, 4), (17, 20)]
    assert regions.scan_regions([], [], "", 2, 1) == []


def test_tiling_covers_with_the_overlap(spark):
    c = spark.createDataFrame([(1, 1234), (2, 10), (3, 0)], "tid bigint, len bigint")
    got = rows(regions.tile(c, 500, 100))
    mine = [(b, e) for t, _, b, e in got if t == 1]
    assert mine[0][0] == 0 and mine[-1][1] == 1234 and all(e - b <= 500 for b, e in mine)
    assert all(a[1] - b[0] >= 100 for a, b in itertools.pairwise(mine))
    assert [x for x in got if x[0] == 2] == [(2, 0, 0, 10)] and not [x for x in got if x[0] == 3]


def test_stitching_gives_the_single_window(spark):
    r = random.Random(2)
    base = [r.choice("ACGT") for _ in range(500)]
    rows_ = [(1, w, p, 0, base[p]) for w, (a, b) in enumerate([(0, 220), (150, 400), (330, 500)]) for p in range(a, b)]
    rows_ = [(t, w, p, i, "N" if (w, p) in ((0, 218), (1, 151)) else b) for t, w, p, i, b in rows_]
    got = regions.stitch(spark.createDataFrame(rows_, "tid bigint, win bigint, pos bigint, ins int, base string"), 20)
    assert [x[3] for x in rows(got)] == base


def alignments(spark, xs):
    from strandwise.functions import cigar as cg

    df = spark.createDataFrame(xs, "rid bigint, tid bigint, pos bigint, c string, seq string")
    return df.withColumn("cigar", cg.parse(F.col("c"))).withColumn("qual", F.array_repeat(F.lit(30), F.length("seq"))).drop("c")


def test_walk_and_padding(spark):
    a = alignments(spark, [(1, 0, 10, "1S3M1I2M1D2M", "NACGTTTAA"), (2, 0, 11, "4M", "CGTT")])
    w = pileup.walk(a)
    mine = [(x.pos, x.ins, x.qidx, x.base) for x in sorted(w.filter("rid = 1").collect(), key=lambda x: (x.pos, x.ins))]
    assert mine == [(10, 0, 1, "A"), (11, 0, 2, "C"), (12, 0, 3, "G"), (12, 1, 4, "T"), (13, 0, 5, "T"), (14, 0, 6, "T"), (15, 0, 7, "-"), (16, 0, 7, "A"), (17, 0, 8, "A")]
    p = pileup.with_padding(w, pileup.spans(a))
    assert rows(p.filter("ins > 0").select("rid", "pos", "ins", "base")) == [(1, 12, 1, "T"), (2, 12, 1, "-")]
    assert rows(pileup.depth(a).filter("pos = 15")) == []
    assert rows(pileup.mpileup(w).filter("pos = 12").select("depth", "bases")) == [(2, "GG")]


def test_deleted_low_site_passes_its_case_on(spark):
    s = [(1, p, 0, b, low) for p, b, low in [(0, "A", False), (1, "-", True), (2, "C", False), (3, "G", False), (4095, "-", True), (4096, "T", False)]]
    got = pileup.consensus_strings(spark.createDataFrame(s, "tid bigint, pos bigint, ins int, base string, low boolean"))
    assert rows(got) == [(1, "AcGt", 4)]


def test_case_is_carried_across_a_chunk_that_prints_nothing(spark):
    schema = "tid bigint, pos bigint, ins int, base string, low boolean"
    for low, want in ((True, "Ac"), (False, "AC")):
        s = [(1, 0, 0, "A", False), (1, 1, 0, "-", low), *[(1, p, 0, "-", False) for p in range(4096, 8192, 512)], (1, 8192, 0, "C", False)]
        assert rows(pileup.consensus_strings(spark.createDataFrame(s, schema))) == [(1, want, 2)]
    s = [(1, 0, 0, "A", False), (1, 4096, 0, "-", True), (1, 8192, 0, "-", False), (1, 12288, 0, "G", False)]
    assert rows(pileup.consensus_strings(spark.createDataFrame(s, schema))) == [(1, "Ag", 2)]


def test_columns_of_a_read_are_those_of_the_walk(spark):
    a = alignments(spark, [(1, 0, 10, "1S3M1I2M1D2M", "NACGTTTAA"), (2, 0, 11, "4M", "CGTT"), (3, 1, 0, "2M2N3M2I", "ACGTACG")])
    walked = sorted((x.rid, x.tid, x.pos, x.ins, x.base) for x in pileup.walk(a).collect())
    cells = sorted((x.rid, x.tid, x.pos, x.ins, x.base) for x in pileup.read_positional_kmers(a).collect())
    assert cells == walked
    want = {}
    for rid in (1, 2, 3):
        shown = [x for x in walked if x[0] == rid]
        for k, x in enumerate(shown):
            want[x[:4]] = "".join([".", ".", *[y[4] for y in shown]][k : k + 3])
    assert {(x.rid, x.tid, x.pos, x.ins): x.kmer for x in pileup.read_kmers(a).collect()} == want
    assert rows(pileup.read_insertions(a)) == rows(pileup.insertion_columns(pileup.walk(a)))


def test_snp_links_read_off_the_cigar(spark):
    a = pileup.spans(alignments(spark, [(1, 0, 1020, "4M2D4M", "ACGTACGT"), (2, 0, 1021, "8M", "CGTTTACG")]).withColumn("mapq", F.lit(60)))
    walked = {(x.rid, x.pos): x.base for x in pileup.walk(a).filter("ins = 0").collect()}
    sites = [1022, 1023, 1024, 1027]
    snps = spark.createDataFrame([(0, p, walked.get((1, p), "-"), walked.get((2, p), "-")) for p in sites], "tid bigint, pos bigint, first string, second string")
    got = {(x.prev_pos, x.pos, x.prev_allele, x.allele): x.num for x in consensus.snp_links(a, snps, width=1024).collect()}
    want = {}
    for rid in (1, 2):
        shown = [(p, 0 if walked[rid, p] == walked[1, p] else 1) for p in sites if (rid, p) in walked]
        for (p, x), (q, y) in itertools.pairwise(shown):
            want[p, q, x, y] = want.get((p, q, x, y), 0) + 1
    assert got == want


def test_semi_join_keeps_equal_rows_apart_from_others(spark):
    left = spark.createDataFrame([(1, 0, 9000, "a"), (1, 0, 9000, "a"), (1, 0, 9000, None), (1, 50, 60, "b"), (2, 0, 5, "c")], "tid bigint, beg bigint, end bigint, name string")
    right = intervals(spark, [(1, 8000, 8100)])
    got = ranges.overlap_join(left, right, how="left_semi")
    assert sorted((x.beg, x.name or "") for x in got.collect()) == [(0, ""), (0, "a"), (0, "a")]
    assert sorted(x.name for x in ranges.overlap_join(left, right, how="left_anti").collect()) == ["b", "c"]


def test_chain_against_a_plain_loop():
    import math

    r = random.Random(21)
    for _ in range(60):
        hits = sorted({(r.randrange(400), r.randrange(400)) for _ in range(r.randrange(1, 40))})
        q, t = [b for _, b in hits], [a for a, _ in hits]
        score = [15.0] * len(hits)
        for i in range(len(hits)):
            for j in range(i):
                dq, dr = q[i] - q[j], t[i] - t[j]
                d = abs(dq - dr)
                if 0 < dq <= 100 and 0 < dr <= 100 and d <= 50:
                    score[i] = max(score[i], score[j] + min(dq, dr, 15) - (0.15 * d + 0.5 * math.log2(d) if d else 0))
        got, members = seeds.best_chain(q, t, 15, 100, 50)
        assert abs(got - max(score)) < 1e-9 and members == sorted(members)


def test_placeholders_and_order(spark):
    from strandwise.operators import candidates

    c = spark.createDataFrame([(1, 5, 2, "ACGTA"), (1, 7, 0, "AC"), (2, 9, 1, "")], "region bigint, cid bigint, order int, seq string")
    assert rows(candidates.reference_first(c).select("cid", "slot")) == [(5, 1), (7, 0), (9, 0)]
    aln = spark.createDataFrame([(1, 7, "AC")], "region bigint, cid bigint, aln string")
    assert rows(candidates.with_placeholders(c, aln)) == [(1, 5, "MMMMM"), (1, 7, "AC---"), (2, 9, "")]
    assert rows(candidates.shortest_candidate(c)) == [(1, 2), (2, 0)]


def test_duplicates_survivors(spark):
    cols = "rid bigint, qname string, flag int, tid bigint, pos bigint, score bigint, c string"
    xs = [(1, "b", 65, 1, 100, 10, "10M"), (2, "b", 145, 1, 200, 10, "10M"), (3, "a", 65, 1, 105, 10, "5S5M"), (4, "a", 145, 1, 200, 10, "10M"), (5, "s", 0, 1, 100, 99, "10M"), (6, "t", 0, 1, 300, 5, "10M"), (7, "u", 0, 1, 300, 9, "10M")]
    from strandwise.functions import cigar as cg

    a = spark.createDataFrame([(r, q, f, t, p if r != 3 else 105, s, c) for r, q, f, t, p, s, c in xs], cols).withColumn("cigar", cg.parse(F.col("c"))).drop("c")
    got = {r.rid: r.duplicate for r in duplicates.markdup(a).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_fixmate_unmapped_takes_the_place_of_its_mate(spark):
    from strandwise.functions import cigar as cg

    a = spark.createDataFrame([(1, "q", 65, 3, 50, 60, "10M", 7), (2, "q", 133, None, None, 0, "*", 9)], "rid bigint, qname string, flag int, tid bigint, pos bigint, mapq int, c string, score bigint")
    got = {r.rid: r for r in duplicates.fixmate(a.withColumn("cigar", cg.parse(F.col("c")))).collect()}
    assert (got[2].tid, got[2].pos, got[2].ms, got[2].MQ) == (3, 50, 7, 60)
    assert got[1].flag & 8 and got[1].mtid == 3 and got[1].ms == 9


def test_n_stats_with_ties(spark):
    c = spark.createDataFrame([(x,) for x in (10, 10, 10, 30, 40, 5)], "len bigint")
    lengths, total, want = [40, 30, 10, 10, 10, 5], 105, []
    for k in range(1, 10):
        run = 0
        for rank, n in enumerate(lengths, 1):
            run += n
            if run >= total * k / 10:
                want.append((k * 10, n, rank))
                break
    assert rows(assembly.n_stats(c)) == want


def test_budget_and_cutoff(spark):
    r = spark.createDataFrame([(i, 10) for i in range(10)], "rid bigint, len bigint")
    assert [x[0] for x in rows(assembly.within_budget(r, 35))] == [0, 1, 2, 3]
    assert assembly.length_cutoff(spark.createDataFrame([(5,), (7,), (9,)], "len bigint"), 8, 2.0) == 7
    assert rows(assembly.greedy_blocks(r.withColumnRenamed("rid", "tid"), 3))[-1][2] == 2


def test_read_filter_and_orders(spark):
    r = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, "ANGT", "ACGT"), (3, "AC", "ACGT")], "rid bigint, seq string, mate_seq string")
    assert [x.rid for x in assembly.read_filter(r, 3).collect()] == [1]
    a = spark.createDataFrame([(1, "r10", 0, 2, 5), (2, "r9", 16, 1, 7), (3, "r9", 0, 1, 7), (4, "x", 4, None, None)], "rid bigint, qname string, flag int, tid bigint, pos bigint")
    assert [x.rid for x in ordering.sort_coordinate(a).collect()] == [3, 2, 1, 4]
    assert [x.rid for x in ordering.sort_name(a).collect()] == [2, 3, 1, 4]
    assert [x.file_idx for x in ordering.merge_sorted(a.filter("rid < 3"), a.filter("rid = 3")).collect()] == [1, 0, 0]
    t = lambda *x: spark.createDataFrame(list(x), "tid bigint, name string, len bigint")
    assert rows(ordering.merge_targets(t((0, "a", 5), (1, "b", 6)), t((0, "c", 7), (1, "a", 5)))) == [(0, "a", 5), (1, "b", 6), (2, "c", 7)]


def test_checksum_ignores_order(spark):
    r = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert rows(report.checksums(r, ("s",))) == rows(report.checksums(r.orderBy(F.desc("s")), ("s",)))


def brute_chain(sites, r):
    """All ways through the sites."""
    best = {None: (0.0, [])}
    first = True
    for _, seen in sites:
        total = sum(n for _, n, _ in seen)
        less = total - 1 if total > 1 else total
        top = max(s for s, _ in best.values())
        now = {}
        for kmer, n, own in seen:
            count = n - 1 if own and total > 1 else n
            before = top if first or kmer[1] not in best else best[kmer[1]][0]
            s = before + count - less * r
            if kmer[2] not in now or s > now[kmer[2]][0]:
                now[kmer[2]] = (s, kmer)
        best, first = now, False
    return max(s for s, _ in best.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from([a + b + c for a in "AC." for b in "AC." for c in "AC-"]), st.integers(1, 9), st.booleans()), min_size=1, max_size=4, unique_by=lambda x: x[0]), min_size=1, max_size=6))
def test_chain_visits_every_site_once(sites):
    numbered = [((i, 0), s) for i, s in enumerate(sites)]
    out = consensus.chain_sites(numbered)
    assert [x[0] for x in out] == list(range(len(sites)))
    assert all(x[2] in {k[2] for k, _, _ in s} for x, s in zip(out, sites))
    assert all(x[4] == sum(n for _, n, _ in s) for x, s in zip(out, sites))


def test_chain_follows_the_reads():
    sites = [((0, 0), [("..A", 5, True)]), ((1, 0), [(".AC", 2, True), (".AG", 4, False)]), ((2, 0), [("ACT", 2, True), ("AGT", 4, False)])]
    assert "".join(x[2] for x in consensus.chain_sites(sites)) == "AGT"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 4), min_size=1, max_size=5))
def test_phasing_is_the_best_of_all_ways(counts):
    sites = list(range(len(counts) + 1))
    links = {(i, i + 1): {(a, b): (c[2 * a + b], 60 * c[2 * a + b], 30 * c[2 * a + b]) for a in (0, 1) for b in (0, 1) if c[2 * a + b]} for i, c in enumerate(counts) if any(c)}
    got = consensus.phase_sites(sites, links)

    def total(way):
        s = 0.0
        for i, c in enumerate(counts):
            seen = links.get((i, i + 1))
            if seen:
                n = sum(x for x, _, _ in seen.values())
                for a, b in ((way[i], way[i + 1]), (1 - way[i], 1 - way[i + 1])):
                    s += consensus.link_score(*seen.get((a, b), (0, 0, 0)), n)
        return s

    best = max(total(w) for w in itertools.product((0, 1), repeat=len(sites)))
    assert total([a for _, a, _ in got]) == pytest.approx(best)


def test_best_path_prefers_support():
    c = lambda p, b: (p, 0, b)
    edges = [(c(0, "A"), None, None, 10), (c(1, "C"), c(0, "A"), None, 7), (c(1, "G"), c(0, "A"), None, 3), (c(2, "T"), c(1, "C"), c(0, "A"), 7), (c(2, "T"), c(1, "G"), c(0, "A"), 3)]
    for kind in ("ont", "clr", "hifi"):
        assert "".join(x[2] for x in consensus.best_path(edges, {0: 10, 1: 10, 2: 10}, kind)) == "ACT"
    assert consensus.best_path([], {}) == []


def test_poa():
    assert consensus.poa(["ACGTACGT"] * 3) == "ACGTACGT"
    assert consensus.poa(["ACGTACGT", "ACGAACGT", "ACGTACGT", "ACGTCGT"]) == "ACGTACGT"
    assert consensus.poa([]) == "" and consensus.poa(["", "AC"]) == "AC"


def edit_score(q, t, match=2, mismatch=4, o=4, e=2):
    from functools import cache

    @cache
    def f(i, j, s):
        if i == 0 and j == 0:
            return 0 if s == 0 else -(10**9)
        best = -(10**9)
        if s == 0 and i and j:
            best = max(f(i - 1, j - 1, k) for k in range(3)) + (match if q[i - 1] == t[j - 1] else -mismatch)
        if s == 1 and i:
            best = max(f(i - 1, j, k) - e - (o if k != 1 else 0) for k in range(3))
        if s == 2 and j:
            best = max(f(i, j - 1, k) - e - (o if k != 2 else 0) for k in range(3))
        return best

    return max(f(len(q), len(t), k) for k in range(3))


@settings(max_examples=80, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=12))
def test_alignment_against_recursion(q, t):
    import re

    score, cigar = seeds.align(q, t)
    assert score == edit_score(q, t)
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MID])", cigar)]
    assert sum(n for n, o in ops if o in "MI") == len(q) and sum(n for n, o in ops if o in "MD") == len(t)
    i = j = s = 0
    for n, o in ops:
        if o == "M":
            s += sum(2 if q[i + k] == t[j + k] else -4 for k in range(n))
            i, j = i + n, j + n
        else:
            s -= 4 + 2 * n
            i, j = i + (n if o == "I" else 0), j + (n if o == "D" else 0)
    assert s == score


def test_chain_dp_skips_outliers():
    q, r = [0, 10, 20, 500, 30], [100, 110, 120, 125, 130]
    score, members = seeds.best_chain(q, r, 10)
    assert members == [0, 1, 2, 4] and score == 40


def test_minimizers_across_chunks(spark):
    r = random.Random(4)
    seq = "".join(r.choice("ACGT") for _ in range(9000))
    got = {x.i: x.hash for x in seeds.minimizers(spark.createDataFrame([(1, seq)], "tid bigint, seq string"), 11, 7).collect()}
    from strandwise.functions.sequence import invertible_hash, kmer_code

    t = seeds.kmer_table(spark.createDataFrame([(1, seq)], "tid bigint, seq string"), 11).select("i", invertible_hash(kmer_code(F.col("kmer")), 22).alias("h"))
    h = [x.h for x in sorted(t.collect())]
    want = {i: h[i] for a in range(len(h) - 6) for i in range(a, a + 7) if h[i] == min(h[a : a + 7])}
    assert got == want


def test_exact_seeds(spark):
    make = lambda s: spark.createDataFrame([(1, s)], "tid bigint, seq string")
    got = rows(seeds.exact_seeds(make("TTTTACGTACGGTTAAC"), make("CCACGTACGGTTAACCC"), 8))
    assert (1, 1, 4, 2, 13) in got


def test_variant_helpers(spark):
    a = spark.createDataFrame([("c", 1, "A", "T"), ("c", 2, "A", "AT")], "chrom string, pos bigint, ref string, alt string")
    b = spark.createDataFrame([("c", 1, "A", "G"), ("c", 2, "A", "AT")], "chrom string, pos bigint, ref string, alt string")
    n = lambda p: sum(r.in_a and r.in_b for r in variants.sync_join(a, b, p).collect())
    assert (n("none"), n("snps"), n("any")) == (1, 2, 2)


def test_haplotypes_need_spanning_reads(spark):
    a = pileup.spans(alignments(spark, [(1, 0, 0, "6M", "ACGTAC"), (2, 0, 0, "6M", "ACTTAC"), (3, 0, 0, "6M", "ACGTAC"), (4, 0, 3, "3M", "TTT")]).withColumn("mapq", F.lit(60)))
    h = consensus.region_haplotypes(a, intervals(spark, [(0, 2, 5)]))
    assert rows(h.select("hap", "num")) == [("GTA", 2), ("TTA", 1)]
    assert consensus.best_haplotypes(h).collect()[0].hap == "GTA"
