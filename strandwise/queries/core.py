"""Statistics, filters, coverage, pile-ups, duplicates, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise import lens
from strandwise.functions import cigar as cg
from strandwise.functions import flags as fl
from strandwise.functions import sequence as sq
from strandwise.lens import ALN, CONTIGS, WALK
from strandwise.operators import assembly, cells, duplicates, ordering, pileup, ranges, regions, report

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _aln(spark: SparkSession, d: str) -> DataFrame:
    return lens.alignments(spark, d)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """Records that a consensus uses, with sequences."""
    return lens.sequences(_aln(spark, d).filter(fl.short_first(F.col("flag"))))


READS = "reads AS (SELECT * FROM aln WHERE flag & 3076 = 0)"


# Sequences and contigs


@query(f"WITH {CONTIGS} SELECT count(*) AS contigs, sum(len)::BIGINT AS total FROM contigs")
def genome_size(spark, d):
    return assembly.genome_size(lens.contigs(spark, d))


@query(f"""WITH {CONTIGS}, r AS (SELECT len, sum(len) OVER (ORDER BY len DESC, tid) AS run, row_number() OVER (ORDER BY len DESC, tid) AS rank, (SELECT sum(len) FROM contigs) AS total FROM contigs),
    k AS (SELECT unnest(range(1, 10)) AS k)
    SELECT (k * 10)::INTEGER AS k, max(len) AS length, min(rank) AS rank FROM r, k WHERE run >= total * k / 10 GROUP BY k""")
def n_stats(spark, d):
    return assembly.n_stats(lens.contigs(spark, d))


@query(f"WITH {CONTIGS} SELECT count(*) AS contigs, min(len) AS shortest, max(len) AS longest, sum(len)::BIGINT AS total, floor(avg(len))::BIGINT AS mean FROM contigs")
def assembly_summary(spark, d):
    return assembly.assembly_summary(lens.contigs(spark, d))


@query(f"""WITH {CONTIGS}, b AS (SELECT len // 1000 AS bin, count(*) AS reads, sum(len)::BIGINT AS bases FROM contigs GROUP BY 1)
    SELECT bin, reads, bases, (sum(bases) OVER (ORDER BY bin DESC))::BIGINT AS bases_from FROM b""")
def length_histogram(spark, d):
    return assembly.length_histogram(lens.contigs(spark, d))


@query(f"""WITH {CONTIGS} SELECT tid, len, ((sum(len) OVER (ORDER BY tid) - len) // ((SELECT sum(len) FROM contigs) // 8 + 1))::BIGINT AS block FROM contigs""")
def block_plan_prefix(spark, d):
    return assembly.block_plan(lens.contigs(spark, d), 8)


@query(f"""WITH RECURSIVE {CONTIGS}, o AS (SELECT tid, len, row_number() OVER (ORDER BY tid) AS i, (SELECT sum(len) // 8 + 1 FROM contigs) AS lim FROM contigs),
    g(i, tid, len, block, have) AS (SELECT i, tid, len, 0::BIGINT, len FROM o WHERE i = 1 UNION ALL
      SELECT o.i, o.tid, o.len, CASE WHEN g.have >= o.lim THEN g.block + 1 ELSE g.block END, CASE WHEN g.have >= o.lim THEN o.len ELSE g.have + o.len END FROM g JOIN o ON o.i = g.i + 1)
    SELECT tid, len, block FROM g""")
def block_plan_greedy(spark, d):
    return assembly.greedy_blocks(lens.contigs(spark, d), 8)


@query(f"""WITH {CONTIGS}, b AS (SELECT tid, len, sum(len) OVER (ORDER BY tid) AS run FROM contigs) SELECT tid, len FROM b WHERE run - len < (SELECT sum(len) FROM contigs) // 2""")
def base_budget(spark, d):
    c = lens.contigs(spark, d)
    total = c.agg(F.sum("len")).collect()[0][0] or 0
    return assembly.within_budget(c.select("tid", "len"), total // 2, "tid")


@query(f"""WITH {CONTIGS} SELECT tid, len FROM contigs WHERE tid % 3 <> 0 OR tid = (SELECT max(tid) FROM contigs WHERE tid % 3 = 0)""")
def restart_antijoin(spark, d):
    c = lens.contigs(spark, d)
    finished = c.filter("tid % 3 = 0").select("contig", F.col("tid").alias("order"))
    return assembly.unfinished(c, finished).select("tid", "len")


@query(f"""WITH {CONTIGS} SELECT DISTINCT contig FROM contigs WHERE len > 500 INTERSECT SELECT contig FROM contigs WHERE contains(seq, 'ACGT')""")
def name_intersect(spark, d):
    c = lens.contigs(spark, d)
    return c.filter("len > 500").select("contig").intersect(c.filter(F.contains("seq", F.lit("ACGT"))).select("contig"))


@query(f"""WITH {CONTIGS} SELECT tid, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) AS rc, upper(seq) = seq AS all_upper, contains(upper(seq), 'N') AS with_n FROM contigs""")
def revcomp(spark, d):
    s = F.col("seq")
    return lens.contigs(spark, d).select("tid", F.md5(sq.reverse_complement(s).cast("binary")).alias("rc"), (F.upper(s) == s).alias("all_upper"), sq.has_n(s).alias("with_n"))


@query(f"""WITH {CONTIGS} SELECT tid, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(seq), 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) AS compressed FROM contigs""")
def homopolymer_compress(spark, d):
    return lens.contigs(spark, d).select("tid", F.md5(sq.homopolymer_compress(F.upper("seq")).cast("binary")).alias("compressed"))


@query(f"""WITH {CONTIGS} SELECT contig AS name, len, md5(upper(seq)) AS m5 FROM contigs""")
def sequence_dictionary(spark, d):
    return lens.contigs(spark, d).select(F.col("contig").alias("name"), "len", F.md5(F.upper("seq").cast("binary")).alias("m5"))


@query(f"""WITH {CONTIGS}, r AS (SELECT tid, unnest(regexp_extract_all(seq, '[a-z]+|[^a-z]+')) AS run FROM contigs) SELECT tid, count(*) FILTER (regexp_matches(run, '^[a-z]')) AS runs,
    coalesce(sum(length(run)) FILTER (regexp_matches(run, '^[a-z]')), 0)::BIGINT AS masked FROM r GROUP BY tid""")
def soft_mask_runs(spark, d):
    runs = lens.contigs(spark, d).filter("len > 0").select("tid", sq.soft_mask_runs(F.col("seq")).alias("r"))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["beg"])
    return runs.select("tid", F.size("r").cast("long").alias("runs"), total.alias("masked"))


@query(f"""WITH {CONTIGS} SELECT tid, substr(seq, 101, 200) AS part, md5(reverse(translate(substr(seq, 101, 200), 'ACGTacgt', 'TGCAtgca'))) AS rc FROM contigs WHERE len > 100""")
def fetch_region(spark, d):
    part = F.substring("seq", 101, 200)
    return lens.contigs(spark, d).filter("len > 100").select("tid", part.alias("part"), F.md5(sq.reverse_complement(part).cast("binary")).alias("rc"))


@query("""SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(regexp_replace(p, '^0+([0-9])', '\\1'))::VARCHAR, 4, '0') || regexp_replace(p, '^0+([0-9])', '\\1') ELSE p END), '') AS key FROM pages""")
def natural_sort_key(spark, d):
    return lens.table(spark, d, "pages").select("page_id", sq.natural_key(F.col("url")).alias("key"))


# Records: flags, CIGARs, filters


@query(f"""WITH {ALN} SELECT flag, count(*) AS n, concat_ws(',', CASE WHEN flag & 1 > 0 THEN 'PAIRED' END, CASE WHEN flag & 4 > 0 THEN 'UNMAP' END, CASE WHEN flag & 16 > 0 THEN 'REVERSE' END, CASE WHEN flag & 64 > 0 THEN 'READ1' END,
    CASE WHEN flag & 128 > 0 THEN 'READ2' END, CASE WHEN flag & 256 > 0 THEN 'SECONDARY' END, CASE WHEN flag & 512 > 0 THEN 'QCFAIL' END, CASE WHEN flag & 1024 > 0 THEN 'DUP' END, CASE WHEN flag & 2048 > 0 THEN 'SUPPLEMENTARY' END) AS names, flag AS again FROM aln GROUP BY flag""")
def flag_text(spark, d):
    n = _aln(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).withColumn("names", fl.to_text(F.col("flag")))
    return n.withColumn("again", fl.from_text(F.col("names")))


@query(f"""WITH {ALN} SELECT rid, CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || '20M' || CASE WHEN ins_len > 0 THEN ins_len || 'I' ELSE '' END || '15M' || CASE WHEN del_len > 0 THEN del_len || 'D' ELSE '' END || (rlen - 35) || 'M' AS cigar,
    ref_len AS ref_span, qlen AS query_span, clip::INTEGER AS clip5, 0 AS clip3, round(clip / qlen, 6) AS ratio, pos - clip AS unclipped, pos + ref_len AS end_pos FROM aln""")
def cigar_spans(spark, d):
    c = F.col("cigar")
    a = _aln(spark, d).withColumn("text", cg.text(c)).withColumn("cigar", cg.parse(F.col("text")))  # there and back
    return a.select(
        "rid", F.col("text").alias("cigar"), cg.reference_span(c).alias("ref_span"), cg.query_span(c).alias("query_span"), cg.clip_length(c, False).alias("clip5"), cg.clip_length(c, True).alias("clip3"),
        F.round(cg.clip_ratio(c, F.col("qlen")), 6).alias("ratio"), cg.unclipped_start(F.col("pos"), c).alias("unclipped"), cg.end_position(F.col("pos"), c, F.lit(False)).alias("end_pos"),
    )


@query(f"""WITH {ALN}, b AS (SELECT rid, wide_pos AS b, wide_pos + ref_len - 1 AS e FROM aln) SELECT rid, (CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17)
    WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END)::BIGINT AS bin FROM b""")
def interval_bins(spark, d):
    return _aln(spark, d).select("rid", cg.interval_bin(F.col("wide_pos"), F.col("wide_pos") + F.col("ref_len")).cast("long").alias("bin"))


@query(f"WITH {ALN} SELECT tid, count(*) AS n, sum(mapq)::BIGINT AS mapq FROM aln WHERE flag & 3076 = 0 GROUP BY tid")
def read_filter_first(spark, d):
    return _aln(spark, d).filter(fl.short_first(F.col("flag"))).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").cast("long").alias("mapq"))


_LEVEL = "CASE WHEN flag & 3076 = 0 AND ((flag & 1 > 0 AND abs(isize) > 0 AND abs(isize) < 600) OR clip / qlen < 0.15) THEN CASE WHEN mapq >= 6 AND clip / qlen < 0.20 THEN 2 ELSE 1 END ELSE 0 END"


@query(f"WITH {ALN} SELECT {_LEVEL} AS level, count(*) AS n, sum(rid % 1000003)::BIGINT AS rids FROM aln GROUP BY 1")
def read_filter_levels(spark, d):
    level = fl.short_level(F.col("flag"), F.col("mapq"), F.col("cigar"), F.col("qlen"), F.col("isize"), 600, 6)
    return _aln(spark, d).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rid") % 1000003).cast("long").alias("rids"))


@query(f"""WITH {ALN} SELECT count(*) FILTER (flag & 3332 = 0 AND clip / qlen <= 0.4) AS phasing, count(*) FILTER (flag & 3332 = 0 AND (qlen - clip) / qlen > 0.9 AND qlen - clip >= 80) AS consensus FROM aln""")
def read_filter_long(spark, d):
    f, c, q = F.col("flag"), F.col("cigar"), F.col("qlen")
    return _aln(spark, d).agg(F.count_if(fl.long_phasing(f, c, q)).alias("phasing"), F.count_if(fl.long_consensus(f, c, q, 0.9, 80)).alias("consensus"))


@query(f"WITH {ALN} SELECT rid, qname, flag, mapq FROM aln WHERE flag & 16 = 16 AND flag & 2308 = 0 AND mapq >= 30 AND qlen >= 70 AND flag & 1040 <> 1040")
def view_flags(spark, d):
    keep = fl.view(F.col("flag"), F.col("mapq"), F.col("qlen"), all_of=16, none=2308, not_all=1040, min_mapq=30, min_length=70)
    return _aln(spark, d).filter(keep).select("rid", "qname", "flag", "mapq")


@query(f"WITH {ALN} SELECT rg, flag & 1024 > 0 AS dup, count(*) AS n FROM aln WHERE rg IS NOT NULL GROUP BY ALL")
def split_read_groups(spark, d):
    return _aln(spark, d).groupBy("rg", fl.has(F.col("flag"), "DUP").alias("dup")).agg(F.count(F.lit(1)).alias("n"))


# Reports


@query(f"""WITH {ALN}, c AS (SELECT flag & 512 > 0 AS f, flag & 2304 = 0 AS p, flag & 4 = 0 AS m, flag, mapq, tid FROM aln), w AS (SELECT unnest(['total','secondary','supplementary','duplicates','mapped','paired','read1','read2','proper','both_mapped','singletons','apart','apart_mapq5']) AS what)
    SELECT what, count(*) FILTER (hit AND NOT f) AS passed, count(*) FILTER (hit AND f) AS failed FROM (SELECT what, f, CASE what WHEN 'total' THEN true WHEN 'secondary' THEN flag & 256 > 0 WHEN 'supplementary' THEN flag & 2048 > 0 WHEN 'duplicates' THEN flag & 1024 > 0 WHEN 'mapped' THEN m
      WHEN 'paired' THEN p AND flag & 1 > 0 WHEN 'read1' THEN p AND flag & 65 = 65 WHEN 'read2' THEN p AND flag & 129 = 129 WHEN 'proper' THEN p AND m AND flag & 3 = 3 WHEN 'both_mapped' THEN p AND flag & 1 > 0 AND flag & 12 = 0
      WHEN 'singletons' THEN p AND flag & 9 = 9 AND m ELSE p AND flag & 1 > 0 AND flag & 12 = 0 AND tid % 2 = 1 AND (what = 'apart' OR mapq >= 5) END AS hit FROM c, w) GROUP BY what""")
def flagstat(spark, d):
    return report.flagstat(_aln(spark, d).withColumn("mtid", F.col("tid") - F.col("tid") % 2))


@query(f"WITH {ALN}, t AS (SELECT unnest(range(0, 12)) AS tid) SELECT t.tid, 20000::BIGINT AS len, count(flag) FILTER (flag & 4 = 0) AS mapped, count(flag) FILTER (flag & 4 > 0) AS unmapped FROM t LEFT JOIN aln ON aln.tid = t.tid GROUP BY t.tid")
def idxstats(spark, d):
    targets = spark.range(12).select(F.col("id").alias("tid"), F.lit(20000).cast("long").alias("len"))
    return report.idxstats(_aln(spark, d), targets)


@query(f"WITH {ALN}, f AS (SELECT isize FROM aln WHERE isize > 0 AND isize < 10000 ORDER BY rid LIMIT 9999) SELECT (sum(isize) // (count(*) + 1))::BIGINT AS mean, (5 * (sum(isize) // (count(*) + 1)))::BIGINT AS insert_limit FROM f")
def insert_size_mean(spark, d):
    return report.insert_mean(_aln(spark, d))


@query(f"""WITH {ALN}, r AS (SELECT tid, isize, row_number() OVER (PARTITION BY tid ORDER BY isize) - 1 AS i, count(*) OVER (PARTITION BY tid) AS n FROM aln WHERE isize > 0)
    SELECT tid, max(isize) FILTER (i = floor(0.25 * n + 0.499)) AS q1, max(isize) FILTER (i = floor(0.5 * n + 0.499)) AS q2, max(isize) FILTER (i = floor(0.75 * n + 0.499)) AS q3 FROM r GROUP BY tid""")
def insert_quartiles(spark, d):
    return report.nearest_rank(_aln(spark, d).filter("isize > 0"), ["tid"], "isize", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


#: First and second reads of a template: the first by id if there are several.
_FIRST = """f1 AS (SELECT * FROM aln WHERE flag & 2304 = 0 AND flag & 65 = 65 QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rid) = 1),
    f2 AS (SELECT * FROM aln WHERE flag & 2304 = 0 AND flag & 129 = 129 QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rid) = 1)"""
_PAIR = f"""{ALN}, {_FIRST}, pr AS (SELECT a.qname, abs(b.pos - a.pos) AS isize, CASE WHEN a.flag & 16 > 0 THEN 'R' ELSE 'F' END || CASE WHEN b.flag & 16 > 0 THEN 'R' ELSE 'F' END AS orientation FROM f1 a JOIN f2 b ON a.qname = b.qname)"""


@query(f"""WITH {_PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY orientation ORDER BY isize) - 1 AS i, count(*) OVER (PARTITION BY orientation) AS n FROM pr),
    q AS (SELECT orientation, max(isize) FILTER (i = floor(0.25 * n + 0.499)) AS q1, max(isize) FILTER (i = floor(0.5 * n + 0.499)) AS q2, max(isize) FILTER (i = floor(0.75 * n + 0.499)) AS q3 FROM r GROUP BY 1),
    b AS (SELECT *, greatest(1, floor(q1 - 2.0 * (q3 - q1) + 0.499))::BIGINT AS low, floor(q3 + 2.0 * (q3 - q1) + 0.499)::BIGINT AS high FROM q)
    SELECT b.orientation, count(*) AS n, q1, q2, q3, low, high, round(avg(isize), 4) AS mean, round(stddev_pop(isize), 4) AS sd FROM b JOIN pr ON pr.orientation = b.orientation AND isize BETWEEN low AND high GROUP BY ALL""")
def insert_statistics(spark, d):
    p = duplicates.pairs(_aln(spark, d), ("pos", "flag"))
    rows = p.select(report.orientation(fl.has(F.col("a_flag"), "REVERSE"), fl.has(F.col("b_flag"), "REVERSE")).alias("orientation"), F.abs(F.col("b_pos") - F.col("a_pos")).alias("isize"))
    return report.insert_statistics(rows).withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query(f"""WITH {ALN}, n AS (SELECT count(*) FILTER (p) AS sequences, count(*) FILTER (p AND m) AS reads_mapped, count(*) FILTER (p AND NOT m) AS reads_unmapped, count(*) FILTER (p AND flag & 1 > 0) AS reads_paired, count(*) FILTER (p AND flag & 1024 > 0) AS reads_duplicated,
    count(*) FILTER (p AND flag & 512 > 0) AS reads_qc_failed, count(*) FILTER (p AND m AND mapq = 0) AS reads_mq0, count(*) FILTER (flag & 256 > 0) AS non_primary, coalesce(sum(qlen) FILTER (p), 0)::BIGINT AS total_length, max(qlen) FILTER (p) AS maximum_length,
    coalesce(sum(qlen) FILTER (p AND m), 0)::BIGINT AS bases_mapped FROM (SELECT *, flag & 2304 = 0 AS p, flag & 4 = 0 AS m FROM aln)) UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE value""".replace("WITH aln", "WITH aln").replace(" UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE value", " SELECT name, value FROM (UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE value)"))
def stats_summary(spark, d):
    return report.summary_numbers(_aln(spark, d))


@query(f"WITH {ALN} SELECT qlen, count(*) AS reads, count(*) FILTER (flag & 64 > 0) AS first, count(*) FILTER (flag & 128 > 0) AS last FROM aln WHERE flag & 2304 = 0 GROUP BY qlen")
def stats_read_lengths(spark, d):
    return report.read_lengths(_aln(spark, d))


@query(f"WITH {ALN} SELECT k::INTEGER AS cycle, ((rid + k) % 41)::SMALLINT AS qual, count(*) AS n FROM (SELECT rid, unnest(range(0, qlen)) AS k FROM aln WHERE flag & 2304 = 0) GROUP BY ALL")
def stats_cycle_qualities(spark, d):
    return report.cycle_qualities(lens.sequences(_aln(spark, d)))


@query(f"WITH {ALN} SELECT abs(isize) AS isize, count(*) FILTER (flag & 16 > 0 AND isize < 0) AS inward, count(*) FILTER (flag & 16 > 0 AND isize > 0) AS outward, count(*) FILTER (flag & 16 = 0) AS other FROM aln WHERE flag & 65 = 65 AND flag & 2316 = 0 AND isize <> 0 GROUP BY 1")
def stats_insert_sizes(spark, d):
    return report.insert_histogram(_aln(spark, d))


@query(f"WITH {ALN}, o AS (SELECT ins_len AS len, 1 AS i, 0 AS d FROM aln WHERE ins_len > 0 UNION ALL SELECT del_len, 0, 1 FROM aln WHERE del_len > 0) SELECT len, sum(i)::BIGINT AS insertions, sum(d)::BIGINT AS deletions FROM o GROUP BY len")
def stats_indels(spark, d):
    return report.indel_histogram(_aln(spark, d))


@query(f"WITH {CONTIGS} SELECT (length(regexp_replace(seq, '[^GCgc]', '', 'g')) * 100 // greatest(len, 1))::BIGINT AS gc, count(*) AS reads FROM contigs GROUP BY 1")
def stats_gc(spark, d):
    return report.gc_histogram(lens.contigs(spark, d))


@query(f"WITH {ALN} SELECT count(*) FILTER (flag & 2308 = 0) AS reads, count(*) FILTER (flag & 2308 = 0 AND qlen - clip < 0.9 * qlen) AS fragmented FROM aln")
def fragmented_share(spark, d):
    return report.fragmented_share(_aln(spark, d).withColumn("aligned", F.col("qlen") - F.col("clip")), 0.9)


@query()
def checksums(spark, d):
    return report.checksums(lens.sequences(_aln(spark, d)).withColumn("quals", F.array_join(F.col("qual").cast("array<string>"), ",")), ("qname", "seq", "quals"))


# Coverage and intervals

_GOOD = "good AS (SELECT * FROM aln WHERE flag & 1796 = 0)"
_BED = "bed AS (SELECT p_partkey AS id, p_partkey % 10 AS tid, (p_partkey * 7919) % 20000 AS beg, (p_partkey * 7919) % 20000 + p_size AS \"end\" FROM part)"


def _bed(spark, d):
    p = F.col("p_partkey").cast("long")
    return lens.table(spark, d, "part").select(p.alias("id"), (p % 10).alias("tid"), ((p * 7919) % 20000).alias("beg"), ((p * 7919) % 20000 + F.col("p_size")).alias("end"))


def _good(spark, d, pos="pos"):
    a = _aln(spark, d).filter(fl.countable(F.col("flag")))
    return a.withColumn("beg", F.col(pos)).withColumn("end", F.col(pos) + F.col("ref_len"))


@query(f"WITH {ALN}, {_GOOD}, p AS (SELECT tid, pos + k AS pos, k, del_len FROM (SELECT tid, pos, del_len, unnest(range(0, ref_len)) AS k FROM good)) SELECT tid, pos, count(*) AS depth FROM p WHERE NOT (k >= 35 AND k < 35 + del_len) GROUP BY ALL")
def depth(spark, d):
    return pileup.depth(_good(spark, d))


@query(f"WITH {ALN}, {_GOOD}, p AS (SELECT tid, pos + unnest(range(0, rlen)) AS pos FROM good), h AS (SELECT least(count(*), 1000) AS depth FROM p GROUP BY tid, pos) SELECT depth, count(*) AS positions FROM h GROUP BY depth".replace("unnest(range(0, rlen)) AS pos FROM good", "k AS pos FROM (SELECT tid, pos, del_len, unnest(range(0, ref_len)) AS k FROM good) WHERE NOT (k >= 35 AND k < 35 + del_len)"))
def stats_coverage(spark, d):
    return report.coverage_histogram(pileup.depth(_good(spark, d)))


@query(f"WITH {ALN}, {_GOOD}, c AS (SELECT unnest(range(0, 10)) AS tid), e AS (SELECT tid, unnest(range(0, 20000)) AS pos FROM c), p AS (SELECT tid, pos + k AS pos FROM (SELECT tid, pos, del_len, unnest(range(0, ref_len)) AS k FROM good) WHERE NOT (k >= 35 AND k < 35 + del_len)), n AS (SELECT tid, pos, count(*) AS n FROM p GROUP BY ALL) SELECT e.tid, e.pos, coalesce(n, 0) AS depth FROM e LEFT JOIN n ON e.tid = n.tid AND e.pos = n.pos")
def depth_all(spark, d):
    return pileup.depth_all(_good(spark, d), spark.range(10).select(F.col("id").alias("tid"), F.lit(20000).cast("long").alias("len")))


@query(f"WITH {ALN}, {_GOOD}, s AS (SELECT tid, unnest(range(ceil((pos + 25) / 10)::BIGINT, floor((pos + ref_len - 25) / 10)::BIGINT + 1)) AS s FROM good) SELECT tid, s * 10 AS pos, count(*) AS depth FROM s GROUP BY ALL")
def window_depth(spark, d):
    return pileup.window_depth(_good(spark, d), 10, 50)


@query(f"WITH {ALN}, {_GOOD}, {_BED} SELECT id, bed.tid, beg, bed.\"end\", coalesce(sum(CASE WHEN rid IS NOT NULL THEN least(bed.\"end\", pos + ref_len) - greatest(beg, pos) END), 0)::BIGINT AS depth_sum FROM bed LEFT JOIN good ON good.tid = bed.tid AND pos < bed.\"end\" AND pos + ref_len > beg GROUP BY ALL")
def bedcov(spark, d):
    return pileup.interval_depth(_good(spark, d), _bed(spark, d)).select("id", "tid", "beg", "end", "depth_sum")


@query(f"WITH {ALN}, {_GOOD}, {_BED} SELECT rid FROM good WHERE EXISTS (SELECT 1 FROM bed WHERE bed.tid = good.tid AND pos < bed.\"end\" AND pos + ref_len > beg)")
def region_overlap_semi(spark, d):
    return ranges.overlap_join(_good(spark, d).select("rid", "tid", "beg", "end"), _bed(spark, d), how="left_semi").select("rid")


@query(f"WITH {ALN}, {_GOOD}, {_BED} SELECT id FROM bed WHERE NOT EXISTS (SELECT 1 FROM good WHERE bed.tid = good.tid AND wide_pos < bed.\"end\" AND wide_pos + ref_len > beg)")
def region_without_reads(spark, d):
    return ranges.overlap_join(_bed(spark, d), _good(spark, d, "wide_pos").select("tid", "beg", "end"), how="left_anti").select("id")


@query(f"WITH {ALN}, {_GOOD}, {_BED} SELECT id, count(*) AS n, sum(mapq)::BIGINT AS mapq FROM bed JOIN good ON good.tid = bed.tid AND pos <= beg AND pos + ref_len >= bed.\"end\" GROUP BY id")
def region_contains(spark, d):
    j = ranges.contains_join(_good(spark, d).select("rid", "tid", "beg", "end", "mapq"), _bed(spark, d))
    return j.groupBy(F.col("r_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").cast("long").alias("mapq"))


_ISLANDS = """WITH ord AS (SELECT tid, b, e, max(e) OVER (PARTITION BY tid ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv), num AS (SELECT *, sum(CASE WHEN m IS NULL OR b > m + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM ord)
    SELECT tid, min(b) AS beg, max(e) AS "end", count(*) AS n FROM num GROUP BY tid, i"""


@query(f"WITH {ALN}, {_GOOD}, iv AS (SELECT tid, wide_pos AS b, wide_pos + ref_len AS e FROM good) SELECT * FROM (" + _ISLANDS.format(gap=5) + ")")
def islands_merge(spark, d):
    return regions.merge_intervals(_good(spark, d, "wide_pos"), gap=5)


_DEPTH = "dp AS (SELECT tid, pos + k AS pos, count(*) AS depth FROM (SELECT tid, pos, del_len, unnest(range(0, ref_len)) AS k FROM good) WHERE NOT (k >= 35 AND k < 35 + del_len) GROUP BY ALL)"


@query(f"WITH {ALN}, {_GOOD}, {_DEPTH}, iv AS (SELECT tid, pos AS b, pos + 1 AS e FROM dp WHERE depth <= 15), x AS (" + _ISLANDS.format(gap=3) + ") SELECT * FROM x WHERE n >= 2")
def islands_lowdepth(spark, d):
    return regions.position_runs(pileup.depth(_good(spark, d)).filter("depth <= 15"), gap=3, least=2)


@query(f"WITH {ALN}, {_GOOD}, {_DEPTH}, m AS (SELECT *, pos - row_number() OVER (PARTITION BY tid ORDER BY pos) AS r FROM dp WHERE depth <= 14) SELECT tid, min(pos) AS beg, max(pos) + 1 AS \"end\" FROM m GROUP BY tid, r HAVING min(depth) <= 6")
def islands_seed_extend(spark, d):
    return regions.seeded_runs(pileup.depth(_good(spark, d)), "tid", F.col("depth") <= 6, F.col("depth") <= 14)


@query(f"WITH {CONTIGS}, n AS (SELECT *, greatest(1, ceil((len - 100) / 400))::BIGINT AS n FROM contigs WHERE len > 0), w AS (SELECT *, ceil((len - 100) / n)::BIGINT AS step, unnest(range(0, n)) AS win FROM n) SELECT tid, win, win * step AS beg, least(win * step + step + 100, len) AS \"end\" FROM w WHERE win * step < least(win * step + step + 100, len)")
def window_tiling(spark, d):
    return regions.tile(lens.contigs(spark, d), 500, 100)


# Pile-ups


@query(f"WITH {ALN}, {READS}, {WALK}, c AS (SELECT tid, pos, ins, base, count(*) AS n FROM walk GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY tid, pos, ins) AS total FROM c) SELECT tid, pos, ins::INTEGER AS ins, substr('ACGT-', base::INTEGER + 1, 1) AS base, n, total::BIGINT AS total, round(n / total, 6) AS share FROM s")
def allele_share(spark, d):
    return pileup.allele_shares(pileup.read_bases(_reads(spark, d))).withColumn("share", F.round("share", 6))


_MAJORITY = """c AS (SELECT tid, pos, ins, substr('ACGT-', base::INTEGER + 1, 1) AS base, count(*) AS n FROM walk GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY tid, pos, ins) AS total, row_number() OVER (PARTITION BY tid, pos, ins ORDER BY n DESC, ascii(base)) AS k FROM c),
    site AS (SELECT tid, pos, ins, base, n, total::BIGINT AS total, n / total < 0.8 AS low FROM s WHERE k = 1)"""


@query(f"WITH {ALN}, {READS}, {WALK}, {_MAJORITY} SELECT tid, pos, ins::INTEGER AS ins, base, n, total, low FROM site")
def base_majority(spark, d):
    return pileup.majority_of(pileup.read_bases(_reads(spark, d)))


@query(f"""WITH {ALN}, {READS}, {WALK}, {_MAJORITY}, o AS (SELECT *, last_value(CASE WHEN base <> '-' THEN rn END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos, ins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY pos, ins) AS rn FROM site)),
    f AS (SELECT *, bool_or(low) OVER (PARTITION BY tid, coalesce(prev, 0)) AS any_low FROM o)
    SELECT tid, string_agg(CASE WHEN base = '-' THEN '' WHEN any_low THEN lower(base) ELSE base END, '' ORDER BY pos, ins) AS seq, count(*) FILTER (base <> '-') AS len FROM f GROUP BY tid""")
def majority_consensus(spark, d):
    return pileup.consensus_strings(pileup.majority_of(pileup.read_bases(_reads(spark, d))))


@query(f"WITH {ALN}, {READS}, {WALK}, {_MAJORITY} SELECT tid, pos, ins::INTEGER AS ins, base AS new_base, CASE WHEN ins = 0 THEN substr('ACGT', ((tid * 7 + pos * pos * 3 + pos) % 4)::INTEGER + 1, 1) ELSE '-' END AS old_base FROM site WHERE base <> CASE WHEN ins = 0 THEN substr('ACGT', ((tid * 7 + pos * pos * 3 + pos) % 4)::INTEGER + 1, 1) ELSE '-' END")
def edit_log(spark, d):
    sites = pileup.majority_of(pileup.read_bases(_reads(spark, d)))
    ref = sites.filter("ins = 0").select("tid", "pos", sq.base_of(lens.ref_base(F.col("tid"), F.col("pos")), "ACGT").alias("base"))
    return pileup.edits(sites, ref)


_KMER3 = """w3 AS (SELECT *, substr('ACGT-', base::INTEGER + 1, 1) AS b FROM walk), l3 AS (SELECT *, coalesce(lag(b, 2) OVER w, '.') || coalesce(lag(b, 1) OVER w, '.') || b AS kmer FROM w3 WINDOW w AS (PARTITION BY rid, tid ORDER BY pos, ins))"""


@query(f"WITH {ALN}, {READS}, {WALK}, {_KMER3} SELECT tid, pos, ins::INTEGER AS ins, kmer, count(*) AS n, min(rid) AS first_rid FROM l3 GROUP BY ALL")
def pileup_kmer3(spark, d):
    return pileup.kmer3(_reads(spark, d))


@query(f"WITH {ALN}, {READS}, {WALK}, {_KMER3}, m AS (SELECT tid, pos, ins, b AS base, count(*) AS n, min(rid) AS first_rid FROM l3 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY tid, pos, ins ORDER BY n DESC, first_rid, base) AS rank FROM m) SELECT tid, pos, ins::INTEGER AS ins, base, n, first_rid, rank::INTEGER AS rank FROM t WHERE rank <= 2")
def top_alleles(spark, d):
    return pileup.top_alleles(pileup.base_counts(pileup.kmer3(_reads(spark, d))).select("tid", "pos", "ins", "base", F.col("n").cast("long").alias("n"), "first_rid"), 2)


@query(f"""WITH {ALN}, {READS}, {WALK}, w3 AS (SELECT *, substr('ACGT-', base::INTEGER + 1, 1) AS b FROM walk), l AS (SELECT tid, pos, ins::INTEGER AS ins, b AS base, lag(pos, 1) OVER w AS p_pos, (lag(ins, 1) OVER w)::INTEGER AS p_ins, lag(b, 1) OVER w AS p_base, lag(pos, 2) OVER w AS pp_pos, (lag(ins, 2) OVER w)::INTEGER AS pp_ins, lag(b, 2) OVER w AS pp_base FROM w3 WINDOW w AS (PARTITION BY rid, tid ORDER BY pos, ins))
    SELECT *, count(*) AS n FROM l GROUP BY ALL""")
def msa_edges(spark, d):
    return pileup.positional_kmer3(_reads(spark, d))


@query(f"WITH {ALN}, {READS} SELECT tid, pos + 19 AS pos, max(ins_len)::INTEGER AS columns FROM reads WHERE ins_len > 0 GROUP BY tid, pos + 19")
def insertion_columns(spark, d):
    return pileup.read_insertions(_reads(spark, d))


@query(f"""WITH {ALN}, {READS}, ic AS (SELECT tid, pos + 19 AS pos, max(ins_len) AS columns FROM reads WHERE ins_len > 0 GROUP BY ALL), cr AS (SELECT rid, r.tid, ic.pos, columns, CASE WHEN ic.pos = r.pos + 19 THEN ins_len ELSE 0 END AS has FROM reads r JOIN ic ON r.tid = ic.tid AND r.pos <= ic.pos AND r.pos + ref_len >= ic.pos + 2)
    SELECT tid, pos, ins::INTEGER AS ins, count(*) FILTER (ins > has) AS gaps FROM (SELECT *, unnest(range(1, columns + 1)) AS ins FROM cr) GROUP BY ALL HAVING count(*) FILTER (ins > has) > 0""")
def insertion_padding(spark, d):
    return pileup.padding_gaps(_reads(spark, d))


@query(f"WITH {ALN}, {READS}, {WALK} SELECT tid, pos, count(*) AS depth, string_agg(substr('ACGT*', base::INTEGER + 1, 1), '' ORDER BY rid) AS bases, string_agg(chr((CASE WHEN base = 4 THEN 33 ELSE 33 + (rid + qidx) % 41 END)::INTEGER), '' ORDER BY rid) AS quals FROM walk WHERE ins = 0 GROUP BY tid, pos")
def mpileup(spark, d):
    return pileup.read_mpileup(_reads(spark, d))


_EVIDENCE = "ev AS (SELECT w.tid, w.pos, count(*) FILTER (ins = 0) AS coverage, count(*) FILTER (ins = 2) AS l_ins, count(*) FILTER (ins = 0 AND base = 4) AS l_del FROM walk w GROUP BY ALL HAVING count(*) FILTER (ins = 0) > 0)"


@query(f"WITH {ALN}, {READS}, {WALK}, {_EVIDENCE} SELECT * FROM ev")
def gap_evidence(spark, d):
    return pileup.evidence(pileup.walk(_reads(spark, d)), 2)


@query(f"WITH {ALN}, {READS}, {WALK}, {_EVIDENCE}, h AS (SELECT tid, pos, pos - row_number() OVER (PARTITION BY tid ORDER BY pos) AS r FROM ev WHERE l_del >= 0.05 * coverage) SELECT tid, min(pos) AS beg, max(pos) + 1 AS \"end\" FROM h GROUP BY tid, r HAVING count(*) >= 8")
def deletion_regions(spark, d):
    return pileup.deletion_regions(pileup.evidence(pileup.walk(_reads(spark, d)), 2), 0.05, 8)


@query(f"""WITH {ALN}, {READS}, {WALK}, {_EVIDENCE}, s AS (SELECT *, sum(l_ins) OVER (PARTITION BY tid ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS around FROM ev), iv AS (SELECT tid, pos AS b, pos + 1 AS e FROM s WHERE l_ins > 0 AND ((l_ins >= 0.3 * coverage AND (l_ins >= 0.1 * coverage OR around >= 0.6 * coverage)) OR (l_ins < 0.1 * coverage AND around >= 0.6 * coverage))),
    x AS ({_ISLANDS.format(gap=30)}) SELECT tid, beg, "end" FROM x""")
def insertion_regions(spark, d):
    return pileup.insertion_regions(pileup.evidence(pileup.walk(_reads(spark, d)), 2))


@query(f"WITH {ALN}, {READS}, {WALK} SELECT rid, count(*) FILTER (ins > 0 OR base = 4 OR (rid * 31 + pos * 17) % 11 = 0) AS nm FROM walk GROUP BY rid")
def edit_distance(spark, d):
    reads = _reads(spark, d).withColumn("target", lens.ref_letters(F.col("tid"), F.col("pos"), F.col("ref_len")))
    return cells.told(reads, "nm").groupBy("rid").agg(F.sum("nm").alias("nm"))


@query(f"""WITH {ALN}, {READS}, {WALK}, q AS (SELECT rid, qname, tid, pos, ins, base, CASE WHEN base = 4 THEN NULL ELSE (rid + qidx) % 41 END AS qual FROM walk), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY qname, tid, pos, ins ORDER BY qual DESC NULLS LAST, rid) AS k, sum(qual) OVER w AS s, min(base) OVER w = max(base) OVER w AS same FROM q WINDOW w AS (PARTITION BY qname, tid, pos, ins))
    SELECT tid, sum(CASE WHEN n < 2 THEN qual WHEN k > 1 THEN 0 WHEN same THEN least(s, 200) ELSE floor(qual * 0.8) END)::BIGINT AS quals, count(*) FILTER (n > 1) AS shared FROM n GROUP BY tid""")
def mate_overlap_quality(spark, d):
    return cells.mate_overlap_sums(_reads(spark, d))


# Mates and duplicates


@query(f"""WITH {ALN}, {_FIRST}, p AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2), m AS (SELECT a.rid, b.flag AS mflag, b.tid AS mtid, b.pos AS mpos, b.mapq AS mmapq, b.score AS mscore, b.ref_len AS mlen FROM p a JOIN p b ON a.qname = b.qname AND ((a.flag & 64 > 0 AND b.flag & 128 > 0) OR (a.flag & 128 > 0 AND b.flag & 64 > 0)))
    SELECT rid, qname, (CASE WHEN mflag IS NULL THEN flag ELSE flag + CASE WHEN mflag & 16 > 0 THEN 32 ELSE 0 END END)::INTEGER AS flag, tid, pos, mtid, mpos, (CASE WHEN mflag IS NULL THEN NULL WHEN tid = mtid THEN (mpos + CASE WHEN mflag & 16 > 0 THEN mlen ELSE 0 END) - (pos + CASE WHEN flag & 16 > 0 THEN ref_len ELSE 0 END) ELSE 0 END)::BIGINT AS isize,
    mmapq AS "MQ", mscore AS ms FROM aln LEFT JOIN m USING (rid)""")
def fixmate(spark, d):
    return duplicates.fixmate(_aln(spark, d))


_FIVE = "CASE WHEN flag & 16 > 0 THEN pos + ref_len ELSE pos - clip END"


@query(f"""WITH {ALN}, u AS (SELECT rid, row_number() OVER (PARTITION BY tid, {_FIVE}, flag & 16 ORDER BY score DESC, rid) > 1 AS dup FROM aln WHERE flag & 2820 = 0) SELECT aln.rid, coalesce(dup, false) AS duplicate FROM aln LEFT JOIN u USING (rid)""")
def markdup_single(spark, d):
    return duplicates.markdup_single(_aln(spark, d)).select("rid", "duplicate")


_MARKDUP = f"""u AS (SELECT rid, qname, flag, tid, {_FIVE} AS five, (flag & 16 > 0)::INTEGER AS rev, score FROM aln WHERE flag & 2820 = 0),
    u1 AS (SELECT * FROM u WHERE flag & 65 = 65 QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rid) = 1), u2 AS (SELECT * FROM u WHERE flag & 129 = 129 QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rid) = 1),
    pp AS (SELECT a.qname, a.rid AS ar, b.rid AS br, {{'t': a.tid, 'f': a.five, 'r': a.rev}} AS ka, {{'t': b.tid, 'f': b.five, 'r': b.rev}} AS kb, a.score + b.score AS s FROM u1 a JOIN u2 b ON a.qname = b.qname),
    pk AS (SELECT *, row_number() OVER (PARTITION BY least(ka, kb), greatest(ka, kb) ORDER BY s DESC, qname) > 1 AS dup FROM pp), pd AS (SELECT ar AS rid, qname, dup FROM pk UNION ALL SELECT br, qname, dup FROM pk), ends AS (SELECT ka AS k FROM pp UNION SELECT kb FROM pp),
    sg AS (SELECT rid, qname, {{'t': tid, 'f': five, 'r': rev}} AS k, score FROM u WHERE rid NOT IN (SELECT rid FROM pd)), sd AS (SELECT rid, qname, k IN (SELECT k FROM ends) OR row_number() OVER (PARTITION BY k ORDER BY score DESC, rid) > 1 AS dup FROM sg),
    md AS (SELECT rid, qname, dup AS duplicate FROM pd UNION ALL SELECT rid, qname, dup FROM sd)"""


@query(f"WITH {ALN}, {_MARKDUP} SELECT * FROM md")
def markdup(spark, d):
    return duplicates.markdup(_aln(spark, d))


@query(f"WITH {ALN}, {_MARKDUP} SELECT rid, qname, qname IN (SELECT qname FROM md WHERE duplicate) AS duplicate FROM aln WHERE flag & 2304 > 0")
def markdup_supplementary(spark, d):
    a = _aln(spark, d)
    return duplicates.mark_supplementary(a, duplicates.markdup(a))


@query(f"WITH {ALN} SELECT rid, row_number() OVER (PARTITION BY lib, tid, pos, flag & 16 ORDER BY mapq DESC, rid) = 1 AS kept FROM aln WHERE flag & 2308 = 0")
def rmdup_legacy(spark, d):
    return duplicates.legacy_rmdup(_aln(spark, d))


@query(f"WITH {ALN}, {_FIRST}, r AS (SELECT a.qname, a.tid, (CASE WHEN a.pos <= b.pos THEN a.flag & 16 = 0 AND b.flag & 16 > 0 ELSE a.flag & 16 > 0 AND b.flag & 16 = 0 END) AND a.tid = b.tid AS proper FROM f1 a JOIN f2 b ON a.qname = b.qname) SELECT tid, count(*) AS pairs, count(*) FILTER (proper) AS proper FROM r GROUP BY tid")
def proper_pairs(spark, d):
    p = duplicates.pairs(_aln(spark, d), ("flag", "tid", "pos"))
    mate = F.col("a_flag") + F.when(fl.has(F.col("b_flag"), "REVERSE"), 0x20).otherwise(0)
    ok = duplicates.proper_pair(mate, F.col("a_tid"), F.col("b_tid"), F.col("a_pos"), F.col("b_pos"))
    return p.groupBy(F.col("a_tid").alias("tid")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(ok).alias("proper"))


# Orders; ranks are given, as rows have no order in a comparison


@query(f"WITH {ALN} SELECT rid, tid, pos, flag, row_number() OVER (ORDER BY tid, pos, flag & 16, rid)::INTEGER AS place FROM aln QUALIFY place <= 1000")
def sort_coordinate_topk(spark, d):
    from pyspark.sql import Window

    top = ordering.sort_coordinate(_aln(spark, d).select("rid", "tid", "pos", "flag")).limit(1000)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ordering.coordinate_key(F.col("tid"), F.col("pos"), F.col("flag")), "rid")))


@query(f"WITH {ALN} SELECT qname, count(*) AS n, min(rid) AS first, max(rid) AS last, bit_xor(flag) AS flags FROM aln GROUP BY qname")
def collate_groups(spark, d):
    return ordering.collate(_aln(spark, d)).groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"), F.max("rid").alias("last"), F.bit_xor("flag").alias("flags"))


@query(f"WITH {ALN}, u AS (SELECT 0 AS file_idx, * FROM aln WHERE flag & 16 = 0 UNION ALL SELECT 1, * FROM aln WHERE flag & 16 > 0) SELECT file_idx, tid, count(*) AS n, sum(pos)::BIGINT AS places FROM u GROUP BY ALL")
def merge_parts(spark, d):
    a = _aln(spark, d).select("rid", "tid", "pos", "flag")
    rev = fl.has(F.col("flag"), "REVERSE")
    return ordering.merge_sorted(a.filter(~rev), a.filter(rev)).groupBy("file_idx", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("places"))
