"""Seeds, variants, haplotypes, recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import lens
from strandwise.functions import flags as fl
from strandwise.functions import sequence as sq
from strandwise.lens import ALN, CONTIGS, WALK
from strandwise.operators import consensus, pileup, seeds
from strandwise.queries.core import READS, _aln, _reads

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KMERS = "km AS (SELECT tid, i, substr(s, i::INTEGER + 1, {k}) AS kmer FROM (SELECT tid, upper(seq) AS s, unnest(range(0, len - {k} + 1)) AS i FROM contigs))"


@query(f"WITH {CONTIGS}, {_KMERS.format(k=20)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT n, count(*) AS kmers FROM c GROUP BY n")
def kmer_count(spark, d):
    return seeds.kmer_counts(lens.contigs(spark, d), 20).groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


_HASH = "xor(h2, h2 >> 15)"
_MINIMIZERS = f"""{_KMERS.format(k=15)}, code AS (SELECT tid, i, list_reduce(list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, b: a * 4 + b) AS h FROM km),
    m1 AS (SELECT tid, i, (xor(h, h >> 15) * 625341585) & 1073741823 AS h1 FROM code), m2 AS (SELECT tid, i, (xor(h1, h1 >> 15) * 2654435761) & 1073741823 AS h2 FROM m1), hs AS (SELECT tid, i, {_HASH} AS hash FROM m2),
    lo AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tid ORDER BY i) >= least(10, count(*) OVER (PARTITION BY tid)) THEN min(hash) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS low FROM hs),
    hi AS (SELECT *, max(low) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS best FROM lo), mz AS (SELECT tid, i, hash FROM hi WHERE hash = best)"""


@query(f"WITH {CONTIGS}, {_MINIMIZERS} SELECT * FROM mz")
def minimizers(spark, d):
    return seeds.minimizers(lens.contigs(spark, d), 15, 10)


_CUT = """n AS (SELECT hash, count(*) AS n FROM mz GROUP BY hash), hist AS (SELECT n, count(*) AS hashes FROM n GROUP BY n), run AS (SELECT n, sum(hashes) OVER (ORDER BY n DESC) AS r, sum(hashes) OVER () AS a FROM hist), cut AS (SELECT max(n) AS cut FROM run WHERE r > a * 0.0002),
    ok AS (SELECT * FROM mz WHERE hash IN (SELECT hash FROM n WHERE n <= (SELECT cut FROM cut)))"""


@query(f"WITH {CONTIGS}, {_MINIMIZERS}, {_CUT} SELECT tid, count(*) AS n, sum(hash)::BIGINT AS hashes FROM ok GROUP BY tid")
def seed_occurrence_cut(spark, d):
    kept = seeds.occurrence_cut(seeds.minimizers(lens.contigs(spark, d), 15, 10))
    return kept.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("hash").cast("long").alias("hashes"))


@query(f"WITH {CONTIGS}, {_MINIMIZERS}, {_CUT}, j AS (SELECT q.tid AS qid, r.tid AS tid, r.i - q.i AS diag FROM ok q JOIN ok r ON q.hash = r.hash AND q.tid < r.tid) SELECT qid, tid, count(*) AS hits, min(diag) AS low, max(diag) AS high FROM j GROUP BY ALL")
def seed_join(spark, d):
    kept = seeds.occurrence_cut(seeds.minimizers(lens.contigs(spark, d), 15, 10))
    diag = F.col("rpos") - F.col("qpos")
    return seeds.seed_join(kept, kept, same=True).groupBy("qid", "tid").agg(F.count(F.lit(1)).alias("hits"), F.min(diag).alias("low"), F.max(diag).alias("high"))


@query(f"""WITH {CONTIGS}, {_MINIMIZERS}, {_CUT}, j AS (SELECT q.tid AS qid, r.tid AS tid, q.i AS qpos, r.i AS rpos, floor((r.i - q.i) / 100)::BIGINT AS b FROM ok q JOIN ok r ON q.hash = r.hash AND q.tid < r.tid),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY qid, tid, b ORDER BY rpos, qpos ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN rpos - lag(rpos) OVER (PARTITION BY qid, tid, b ORDER BY rpos, qpos) <= 5000 THEN 0 ELSE 1 END AS nw FROM j))
    SELECT qid, tid, min(qpos) AS qbeg, max(qpos) AS qend, min(rpos) AS rbeg, max(rpos) AS rend, count(*) AS n FROM g GROUP BY qid, tid, b, c""")
def greedy_chains(spark, d):
    kept = seeds.occurrence_cut(seeds.minimizers(lens.contigs(spark, d), 15, 10))
    return seeds.diagonal_chains(seeds.seed_join(kept, kept, same=True))


@query()
def chain_dp(spark, d):
    kept = seeds.occurrence_cut(seeds.minimizers(lens.contigs(spark, d), 15, 10))
    return seeds.chains(seeds.seed_join(kept, kept, same=True), 15, 30.0)


@query()
def extension(spark, d):
    """Base alignment of the read of each record, without what its CIGAR clips, with its stretch of the reference."""
    reads = _reads(spark, d)
    target = lens.ref_letters(F.col("tid"), F.col("pos"), F.col("ref_len"))
    return seeds.align_pairs(reads.select("rid", F.substring(F.col("seq"), F.col("clip").cast("int") + 1, F.length("seq")).alias("query"), target.alias("target"))).select("rid", "score", "cigar")


@query(f"""WITH {CONTIGS}, c AS (SELECT tid % 20 AS region, tid AS cid, upper(seq) AS s FROM contigs), p AS (SELECT region, cid, substr(s, 1, 40) AS t FROM c UNION ALL SELECT region, cid, CASE WHEN length(s) > 40 THEN right(s, 40) ELSE '' END FROM c),
    e AS (SELECT region, cid, substr(t, i::INTEGER + 1, 8) AS kmer FROM (SELECT *, unnest(range(0, length(t) - 7)) AS i FROM p)), n AS (SELECT region, kmer, count(*) AS n FROM e GROUP BY ALL) SELECT region, cid, sum(n)::BIGINT AS score FROM e JOIN n USING (region, kmer) GROUP BY ALL""")
def kmer_score(spark, d):
    c = lens.contigs(spark, d).select((F.col("tid") % 20).alias("region"), F.col("tid").alias("cid"), "seq")
    return seeds.kmer_score(c)


@query(f"""WITH {ALN}, r AS (SELECT qname, rid, clip AS b, clip + rlen AS e, score + 20 AS score FROM aln), h AS (SELECT DISTINCT a.rid FROM r a JOIN r b ON a.qname = b.qname AND (b.score > a.score OR (b.score = a.score AND b.rid < a.rid)) AND least(a.e, b.e) - greatest(a.b, b.b) >= least(a.e - a.b, b.e - b.b) * 0.5),
    m AS (SELECT *, rid NOT IN (SELECT rid FROM h) AS prim FROM r), s AS (SELECT qname, max(score) FILTER (NOT prim) AS sub FROM m GROUP BY qname)
    SELECT rid, prim AS "primary", coalesce(sub, 0)::BIGINT AS sub_score, CASE WHEN score > 0 THEN greatest(0, least(60, trunc(40 * (1 - coalesce(sub, 0) / score) * least(1.0, 7 / 10.0) * ln(greatest(e - b, 1)))))::INTEGER ELSE 0 END AS mapq FROM m JOIN s USING (qname)""")
def primary_and_mapq(spark, d):
    a = _aln(spark, d).select(F.col("qname").alias("qid"), F.col("rid").alias("rank_id"), F.col("clip").alias("qbeg"), (F.col("clip") + F.col("rlen")).alias("qend"), (F.col("score") + 20).cast("double").alias("score"))
    m = seeds.mark_primary(a)
    return m.select(F.col("rank_id").alias("rid"), "primary", F.col("sub_score").cast("long").alias("sub_score"), seeds.long_mapq(F.col("score"), F.col("sub_score"), F.lit(7), F.col("qend") - F.col("qbeg")).alias("mapq"))


# Variants and haplotypes

_SNPS = """cnt AS (SELECT tid, pos, base, count(*) AS n, min(rid) AS fr FROM walk WHERE ins = 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY tid, pos ORDER BY n DESC, fr, substr('ACGT-', base::INTEGER + 1, 1)) AS k FROM cnt),
    tp AS (SELECT tid, pos, max(base) FILTER (k = 1) AS b1, max(base) FILTER (k = 2) AS b2, max(n) FILTER (k = 1) AS n1, coalesce(max(n) FILTER (k = 2), 0) AS n2, (tid * 7 + pos * pos * 3 + pos) % 4 AS rb FROM rk GROUP BY tid, pos),
    sn AS (SELECT *, CASE WHEN n2 / n1 < 0.34 AND b1 = rb THEN 0 WHEN n2 = 0 OR (n1 >= 5 AND b1 <> rb AND n2 / n1 < 0.34) THEN 2 ELSE 1 END AS call FROM tp)"""


def _snps(reads):
    counts = pileup.read_bases(reads, first=True).filter("ins = 0").drop("ins")
    ref = counts.select("tid", "pos").distinct().select("tid", "pos", sq.base_of(lens.ref_base(F.col("tid"), F.col("pos")), "ACGT").alias("base"))
    return consensus.call_snps(counts, ref)


@query(f"WITH {ALN}, {READS}, {WALK}, {_SNPS} SELECT tid, pos, substr('ACGT-', rb::INTEGER + 1, 1) AS ref, substr('ACGT-', b1::INTEGER + 1, 1) AS first, substr('ACGT-', b2::INTEGER + 1, 1) AS second, n1, n2, call FROM sn")
def snp_call(spark, d):
    return _snps(_reads(spark, d))


_LINKS = """al AS (SELECT w.rid, w.tid, w.pos, w.mapq, CASE WHEN w.base = 4 THEN NULL ELSE (w.rid + w.qidx) % 41 END AS qual, CASE WHEN w.base = b1 THEN 0 ELSE 1 END AS a FROM walk w JOIN sn ON w.tid = sn.tid AND w.pos = sn.pos AND w.ins = 0 AND call = 1 AND (w.base = b1 OR w.base = b2)),
    lk AS (SELECT tid, pos, mapq, qual, a, lag(pos) OVER o AS prev_pos, lag(a) OVER o AS prev_a FROM al WINDOW o AS (PARTITION BY rid, tid ORDER BY pos))"""


@query(f"WITH {ALN}, {READS}, {WALK}, {_SNPS}, {_LINKS} SELECT tid, pos, prev_pos, prev_a::INTEGER AS prev_allele, a::INTEGER AS allele, count(*) AS num, sum(mapq)::BIGINT AS mapq_sum, coalesce(sum(qual), 0)::BIGINT AS qual_sum FROM lk WHERE prev_pos IS NOT NULL GROUP BY ALL")
def snp_links(spark, d):
    return consensus.snp_links(pileup.spans(_reads(spark, d)), _snps(_reads(spark, d)).filter("call = 1"))


@query()
def snp_phase_dp(spark, d):
    snps = _snps(_reads(spark, d)).filter("call = 1")
    return consensus.phase(snps, consensus.snp_links(pileup.spans(_reads(spark, d)), snps))


@query(f"""WITH {ALN}, {READS}, {WALK}, {_SNPS}, sf AS (SELECT tid, pos, call = 1 AS snp FROM sn), an AS (SELECT tid, pos, snp, last_value(CASE WHEN NOT snp THEN pos END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN NOT snp THEN pos END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM sf) SELECT tid, pos, l AS "left", r AS "right" FROM an WHERE snp""")
def snp_anchors(spark, d):
    return consensus.anchors(_snps(_reads(spark, d)).select("tid", "pos", (F.col("call") == 1).alias("snp")))


_REGION = "rg AS (SELECT unnest(range(0, 10)) AS tid), reg AS (SELECT tid, b AS beg, b + 12 AS \"end\" FROM (SELECT tid, unnest(range(0, 20000, 40)) AS b FROM rg))"


@query(f"""WITH {ALN}, {READS}, {WALK}, {_REGION}, sp AS (SELECT r.rid, r.tid, r.mapq, beg, reg."end" FROM reads r JOIN reg ON r.tid = reg.tid AND r.pos <= beg AND r.pos + ref_len >= reg."end"),
    hp AS (SELECT sp.rid, sp.tid, beg, sp."end", sp.mapq, string_agg(CASE WHEN base = 4 THEN '' ELSE substr('ACGT', base::INTEGER + 1, 1) END, '' ORDER BY w.pos, ins) AS hap, floor(avg(CASE WHEN base <> 4 THEN (w.rid + qidx) % 41 END))::BIGINT AS q FROM sp JOIN walk w ON w.rid = sp.rid AND w.pos >= beg AND w.pos < sp."end" GROUP BY ALL),
    hc AS (SELECT tid, beg, "end", hap, count(*) AS num, sum(mapq)::BIGINT AS mapq_sum, sum(q)::BIGINT AS qual_sum, min(rid) AS first_rid FROM hp GROUP BY ALL)
    SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY tid, beg, "end" ORDER BY (mapq_sum = 3000) DESC, num DESC, mapq_sum DESC, qual_sum DESC, first_rid) = 1""")
def haplotype_best(spark, d):
    reads = pileup.spans(_reads(spark, d))
    regions = spark.range(0, 20000, 40).crossJoin(spark.range(10).withColumnRenamed("id", "tid")).select("tid", F.col("id").alias("beg"), (F.col("id") + 12).alias("end"))
    return consensus.best_haplotypes(consensus.region_haplotypes(reads, regions))


@query(f"""WITH {ALN}, r AS (SELECT tid, rid, mapq, coalesce(sum((mapq = 60)::INTEGER) OVER (PARTITION BY tid ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM aln WHERE flag & 3076 = 0) SELECT tid, rid, mapq FROM r WHERE seen < 50""")
def observation_limit(spark, d):
    reads = _aln(spark, d).filter(fl.short_first(F.col("flag"))).select("tid", "rid", "mapq")
    return consensus.limited_observations(reads, ["tid"])


@query(f"""WITH {CONTIGS}, c AS (SELECT tid % 20 AS region, upper(seq) AS seq FROM contigs), n AS (SELECT region, seq, count(*) AS n FROM c GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, length(seq) DESC, seq) = 1""")
def identical_vote(spark, d):
    return consensus.identical_vote(lens.contigs(spark, d).select((F.col("tid") % 20).alias("region"), F.upper("seq").alias("seq")))


@query(f"""WITH {CONTIGS}, c AS (SELECT tid % 50 AS region, tid AS cid, seq, len, (tid * 7919) % 101 + 20 AS score FROM contigs), x AS (SELECT *, quantile_cont(len, 0.5) OVER (PARTITION BY region) AS med, max(score) OVER (PARTITION BY region) AS top, lag(len) OVER (PARTITION BY region ORDER BY len, cid) AS less, lag(score) OVER (PARTITION BY region ORDER BY score DESC, cid) AS prev FROM c),
    g AS (SELECT * FROM x WHERE len <= 2 * med AND (less IS NULL OR len <= 1.4 * less) AND score >= 0.1 * top AND (prev IS NULL OR score >= 0.5 * prev)) SELECT region, cid, score FROM g QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, cid) <= 30""")
def candidate_pruning(spark, d):
    c = lens.contigs(spark, d).select((F.col("tid") % 50).alias("region"), F.col("tid").alias("cid"), "seq", ((F.col("tid") * 7919) % 101 + 20).alias("score"))
    return consensus.prune_candidates(c).select("region", "cid", "score")


# Recurrences; their tests compare with all paths on small inputs


def _counts(spark, d):
    """Three-mers of the reads and of the contigs that the lens has for them, in windows."""
    reads = _reads(spark, d)
    width = pileup.spans(reads).groupBy("tid").agg((F.max("end") - 1).alias("last"))
    letter = lambda p: sq.base_of(lens.ref_base(F.col("tid"), p), "ACGT")
    contigs = width.select("tid", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), letter), "").alias("seq"))
    return consensus.counted_read_kmers(reads, contigs)


@query()
def score_chain(spark, d):
    from strandwise.operators.regions import stitch

    windows = consensus.windowed(_counts(spark, d), 5000, 1000)
    chained = consensus.score_chain(windows, keys=("tid", "win"))
    return stitch(chained.select("tid", "win", "pos", "ins", "base"), 50)


@query()
def msa_best_path(spark, d):
    reads = _reads(spark, d)
    edges = consensus.windowed(pileup.positional_kmer3(reads), 5000, 1000)
    coverage = consensus.windowed(pileup.depth(reads, skip_deletions=False).select("tid", "pos", F.col("depth").alias("coverage")), 5000, 1000)
    return consensus.msa_consensus(edges, coverage, keys=("tid", "win"))


@query()
def poa_consensus(spark, d):
    """Contigs in groups of six neighbours, each cut into windows of 16 bases; the windows with one number are aligned to
    one graph."""
    c = lens.contigs(spark, d).filter("len > 0").select("tid", F.upper("seq").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / 16))).alias("win"))
    parts = c.select(F.floor(F.col("tid") / 6).alias("region"), "win", "tid", F.substring(F.col("s"), (F.col("win") * 16 + 1).cast("int"), F.lit(16)).alias("s"))
    groups = parts.groupBy("region", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("tid", "s"))), lambda x: x["s"]).alias("seqs"))
    return consensus.poa_consensus(groups).select("region", "win", "consensus")


@query()
def region_scan(spark, d):
    from strandwise.operators.regions import find_regions

    sites = pileup.majority_of(pileup.read_bases(_reads(spark, d))).select("tid", "pos", "ins", F.col("low").alias("flagged"), "base")
    return find_regions(sites, 5, 1)
