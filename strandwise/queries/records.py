"""Aligned pairs, difference strings, clips, tags, packed sequences, split reads, edits of variant records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import lens
from strandwise.functions import flags as fl
from strandwise.functions import pairs as pr
from strandwise.functions.cigar import total
from strandwise.lens import ALN, CONTIGS, WALK
from strandwise.operators import cells, masks, pileup, report, seeds, splits, variants
from strandwise.queries.core import READS, _aln, _bed, _reads
from strandwise.queries.more import _VAR, _variants

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark, d):
    """rid, tid, pos, cigar, and p: the pair of each read and the contig's stretch under it."""
    return _targeted(spark, d).select("rid", "tid", "pos", "cigar", pr.gapped(F.col("cigar"), F.col("seq"), F.col("target")).alias("p"))


def _targeted(spark, d):
    """The reads, and the contig's stretch under each."""
    return _reads(spark, d).withColumn("target", lens.ref_letters(F.col("tid"), F.col("pos"), F.col("ref_len")))


_LETTERS = """cells AS (SELECT rid, pos, ins, substr('ACGT-', base::INTEGER + 1, 1) AS q, CASE WHEN ins > 0 THEN '-' ELSE substr('ACGT', ((tid * 7 + pos * pos * 3 + pos) % 4)::INTEGER + 1, 1) END AS t FROM walk)"""
_CELLS = f"{ALN}, {READS}, {WALK}, {_LETTERS}"


@query(f"WITH {_CELLS} SELECT rid, string_agg(q, '' ORDER BY pos, ins) AS q, string_agg(t, '' ORDER BY pos, ins) AS t FROM cells GROUP BY rid")
def aligned_pairs(spark, d):
    return cells.told(_targeted(spark, d), "pair")


@query(f"WITH {_CELLS} SELECT rid, count(*) FILTER (q <> t) AS nm, round(count(*) FILTER (q = t) / count(*), 6) AS identity FROM cells GROUP BY rid")
def pair_identity(spark, d):
    return _pairs(spark, d).select("rid", pr.differences(F.col("p")).alias("nm"), F.round(pr.identity(F.col("p")), 6).alias("identity"))


@query(rf"""WITH {_CELLS}, c AS (SELECT rid, string_agg(CASE WHEN t = '-' THEN '' WHEN q = '-' THEN lower(t) WHEN q = t THEN '.' ELSE t END, '' ORDER BY pos, ins) || '$' AS code FROM cells GROUP BY rid),
    e AS (SELECT rid, unnest(regexp_extract_all(code, '\.*(?:[A-Z]|[a-z]+|\$)')) AS x, generate_subscripts(regexp_extract_all(code, '\.*(?:[A-Z]|[a-z]+|\$)'), 1) AS i FROM c), y AS (SELECT *, ltrim(x, '.') AS ev FROM e)
    SELECT rid, string_agg(length(x) - length(ev) || CASE WHEN ev = '$' THEN '' WHEN ev = lower(ev) THEN '^' || upper(ev) ELSE ev END, '' ORDER BY i) AS md FROM y GROUP BY rid""")
def md_strings(spark, d):
    return cells.told(_targeted(spark, d), "md")


@query(f"""WITH {_CELLS}, c AS (SELECT *, row_number() OVER w AS i, CASE WHEN q = t THEN ':' WHEN t = '-' THEN '+' WHEN q = '-' THEN '-' ELSE '*' END AS k FROM cells WINDOW w AS (PARTITION BY rid ORDER BY pos, ins)),
    m AS (SELECT *, CASE WHEN k = '*' OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS n FROM c), g AS (SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY i) AS run FROM m),
    r AS (SELECT rid, run, k, count(*) AS len, string_agg(lower(q), '' ORDER BY i) AS q, string_agg(lower(t), '' ORDER BY i) AS t FROM g GROUP BY rid, run, k)
    SELECT rid, string_agg(k || CASE k WHEN ':' THEN len::VARCHAR WHEN '+' THEN q WHEN '-' THEN t ELSE t || q END, '' ORDER BY run) AS cs FROM r GROUP BY rid""")
def cs_strings(spark, d):
    return cells.told(_targeted(spark, d), "cs")


@query(f"""WITH {_CELLS}, c AS (SELECT rid, string_agg(q, '' ORDER BY pos, ins) AS q, string_agg(t, '' ORDER BY pos, ins) AS t, string_agg(CASE WHEN q = t THEN '=' ELSE 'x' END, '' ORDER BY pos, ins) AS a FROM cells GROUP BY rid),
    f AS (SELECT *, instr(a, '========') AS beg, length(a) - instr(reverse(a), '========') + 1 AS fin FROM c)
    SELECT rid, substr(q, beg, fin - beg + 1) AS q, substr(t, beg, fin - beg + 1) AS t, length(replace(substr(t, 1, beg - 1), '-', '')) AS skipped FROM f WHERE beg > 0 AND fin - beg + 1 >= 60""")
def exact_ends(spark, d):
    some = F.explode(F.filter(F.array(pr.exact_ends(F.col("p"), 8, 60)), lambda x: x.isNotNull()))
    return _pairs(spark, d).select("rid", some.alias("e")).select("rid", "e.q", "e.t", F.col("e.skipped").cast("long").alias("skipped"))


@query(f"""WITH {ALN}, {READS}, {WALK} SELECT w.rid, min(w.pos) AS pos, min(w.qidx) FILTER (ins > 0 OR base < 4) AS qbeg, count(*) FILTER (ins = 0 AND base < 4) AS m, count(*) FILTER (ins > 0) AS i, count(*) FILTER (base = 4) AS d
    FROM walk w JOIN (SELECT DISTINCT rid, pos AS beg FROM reads) r ON w.rid = r.rid AND w.pos >= (beg // 64 + 1) * 64 AND w.pos < (beg // 64 + 1) * 64 + 25 WHERE true GROUP BY w.rid HAVING count(*) FILTER (base < 4 OR ins > 0) > 0""")
def clip_to_window(spark, d):
    beg = (F.floor(F.col("pos") / 64) + 1) * 64
    c = _aln(spark, d).filter(fl.short_first(F.col("flag"))).select("rid", pr.clip_to_window(F.col("pos"), F.col("cigar"), beg, beg + 25).alias("c"))
    return c.filter(total(F.col("c.cigar"), ("M", "I")) > 0).select("rid", "c.pos", F.col("c.qbeg").cast("long").alias("qbeg"), *[total(F.col("c.cigar"), (op,)).alias(op.lower()) for op in "MID"])


_CIGAR = "(CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END) || '20M' || (CASE WHEN ins_len > 0 THEN ins_len || 'I' ELSE '' END) || '15M' || (CASE WHEN del_len > 0 THEN del_len || 'D' ELSE '' END) || (rlen - 35) || 'M'"


@query(f"""WITH {ALN}, m AS (SELECT *, (CASE WHEN flag & 64 > 0 THEN '1' ELSE '2' END) || (CASE WHEN flag & 16 > 0 THEN 'R' ELSE 'F' END) || {_CIGAR} AS shown FROM aln)
    SELECT a.rid AS first, b.rid AS second, CASE WHEN a.pos > b.pos THEN b.shown || (a.pos - b.pos - b.ref_len) || 'T' || a.shown ELSE a.shown || (b.pos - a.pos - a.ref_len) || 'T' || b.shown END AS ct
    FROM m a JOIN m b ON a.qname = b.qname AND a.line = 1 AND b.line = 2 AND a.tid = b.tid""")
def template_cigars(spark, d):
    m = _aln(spark, d).select("qname", "line", "rid", F.struct("tid", "pos", "flag", "cigar").alias("m"))
    a, b = (m.filter(F.col("line") == k).select("qname", F.col("rid").alias(name), F.col("m").alias(f"m{k}")) for k, name in ((1, "first"), (2, "second")))
    return a.join(b, "qname").select("first", "second", pr.template_cigar(F.col("m1"), F.col("m2")).alias("ct")).filter("ct is not null")


@query(f"WITH {ALN} SELECT rid, 'AS:' || score || (CASE WHEN lib = 0 THEN '' ELSE ';LB:lib1' END) || ';RG:new' AS tags FROM aln")
def tag_edits(spark, d):
    tags = F.create_map(F.lit("RG"), F.col("rg"), F.lit("AS"), F.lit("0"), F.lit("NM"), F.col("score").cast("string"))
    edited = pr.set_tag(pr.set_tag(tags, "RG", F.lit("new")), "AS", F.col("score").cast("string"))
    out = pr.set_tag(pr.drop_tags(edited, "NM"), "LB", F.when(F.col("lib") == 1, "lib1"))
    return _aln(spark, d).select("rid", F.array_join(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("tags"))


@query(f"WITH {CONTIGS} SELECT tid, ceil(len / 31)::BIGINT AS words, md5(upper(seq)) AS whole, md5(substr(upper(seq), len // 3 + 1, 2 * len // 3 - len // 3)) AS middle FROM contigs")
def packed_sequences(spark, d):
    c = lens.contigs(spark, d).withColumn("w", pr.pack(F.col("seq")))
    third = lambda k: F.floor(F.col("len") * k / 3)
    digest = lambda x: F.md5(x.cast("binary"))
    return c.select("tid", F.size("w").cast("long").alias("words"), digest(pr.unpack(F.col("w"), F.col("len"))).alias("whole"), digest(pr.packed_substring(F.col("w"), F.col("len"), third(1), third(2))).alias("middle"))


# Split reads: lines of an order are pieces of one read of 400 bases


_PARTS = """parts AS (SELECT 'q' || l_orderkey AS qname, l_orderkey % 10 AS tid, CASE WHEN l_orderkey % 4 < 2 THEN '+' ELSE '-' END AS strand, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 60 ELSE 190 + l_suppkey % 60 END AS qbeg,
    CASE WHEN l_linenumber % 2 = 1 THEN 150 + l_suppkey % 50 ELSE 340 + l_partkey % 60 END AS qend, 400 AS qlen, (l_orderkey * 53) % 200000 + l_linenumber * 160 + l_suppkey % 50 AS beg,
    (l_orderkey * 53) % 200000 + l_linenumber * 160 + l_suppkey % 50 + 150 + l_partkey % 7 AS "end" FROM lineitem),
    pairs AS (SELECT *, lag(qbeg) OVER w AS pqbeg, lag(qend) OVER w AS pqend, lag(beg) OVER w AS pbeg, lag("end") OVER w AS pend FROM parts WINDOW w AS (PARTITION BY qname, tid, strand ORDER BY qbeg, beg, "end", qend)),
    gaps AS (SELECT qname, tid, strand, least(pend, beg) AS beg, greatest(pend, beg) AS "end", beg - pend AS ref_gap, qbeg - pqend AS read_gap, beg - pend - qbeg + pqend AS label FROM pairs
        WHERE beg >= pbeg AND "end" >= pend AND pqbeg < 40 AND qlen - qend < 40 AND abs(beg - pend) < 30000 AND abs(qbeg - pqend) < 30000)"""


def _gaps(spark, d):
    key, line, part, supp = (F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    odd, beg = line % 2 == 1, (key * 53) % 200000 + line * 160 + supp % 50
    parts = lens.spread(lens.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select(
        F.concat(F.lit("q"), key).alias("qname"), (key % 10).alias("tid"), F.when(key % 4 < 2, "+").otherwise("-").alias("strand"),
        F.when(odd, part % 60).otherwise(190 + supp % 60).alias("qbeg"), F.when(odd, 150 + supp % 50).otherwise(340 + part % 60).alias("qend"),
        F.lit(400).alias("qlen"), beg.alias("beg"), (beg + 150 + part % 7).alias("end"),
    )
    return splits.split_gaps(parts)


@query(f'WITH {_PARTS} SELECT qname, tid, strand, beg, "end", ref_gap, read_gap, label FROM gaps')
def split_gaps(spark, d):
    return _gaps(spark, d)


_CLUSTERS = """reach AS (SELECT *, max("end") OVER (PARTITION BY tid ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM gaps),
    isl AS (SELECT *, sum(CASE WHEN r IS NULL OR beg > r THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS i FROM reach),
    clusters AS (SELECT tid, i, min(beg) AS beg, max("end") AS "end", count(*) AS n, count(*) FILTER (label > 0) AS valid FROM isl GROUP BY tid, i)"""


@query(f"""WITH {_PARTS}, {_CLUSTERS}, k AS (SELECT tid, i, label, count(*) AS k, CASE WHEN abs(label) >= 1000 THEN 100 WHEN abs(label) >= 800 THEN 80 WHEN abs(label) >= 400 THEN 40 WHEN abs(label) >= 200 THEN 20 ELSE 10 END AS o FROM isl GROUP BY tid, i, label),
    near AS (SELECT a.tid, a.i, a.label, sum(b.k) AS near FROM k a JOIN k b ON a.tid = b.tid AND a.i = b.i AND b.label BETWEEN a.label - a.o AND a.label + a.o GROUP BY ALL)
    SELECT tid, c.beg, c."end", c.n, c.valid, arg_min(label, (-near, label)) AS typical FROM clusters c JOIN near USING (tid, i) GROUP BY ALL""")
def gap_clusters(spark, d):
    return splits.gap_clusters(_gaps(spark, d))


@query(f"WITH {ALN}, s AS (SELECT tid, ref_len, row_number() OVER (PARTITION BY tid ORDER BY ref_len) - 1 AS i, count(*) OVER (PARTITION BY tid) AS n FROM aln) SELECT tid, greatest((ref_len + 1) // 2, 30) AS width FROM s WHERE i = n // 2")
def window_width(spark, d):
    return splits.window_width(_aln(spark, d).select("tid", F.col("pos").alias("beg"), (F.col("pos") + F.col("ref_len")).alias("end")), 2, 30)


@query(f"""WITH {_PARTS}, b AS (SELECT DISTINCT p_partkey % 10 AS tid, (p_partkey * 7919) % 20000 AS beg, (p_partkey * 7919) % 20000 + p_size AS "end" FROM part),
    low AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.tid = b.tid AND g.beg < greatest(b."end", b.beg + 1) AND greatest(g."end", g.beg + 1) > b.beg)),
    s AS (SELECT tid, beg, "end", unnest(range(beg, "end")) AS pos FROM low) SELECT tid, beg, "end", arg_min(pos, (-((pos * 31 + tid) % 60), pos)) AS point FROM s WHERE pos % 3 = 0 GROUP BY ALL""")
def split_points(spark, d):
    low = _bed(spark, d).select("tid", "beg", "end").distinct()
    pos = low.select("tid", F.explode(F.sequence("beg", "end")).alias("pos")).distinct().filter("pos % 3 = 0")
    return splits.split_points(low, _gaps(spark, d), pos.withColumn("qv", (F.col("pos") * 31 + F.col("tid")) % 60))


@query(f"""WITH {CONTIGS}, b AS (SELECT *, CASE WHEN tid % 3 = 0 AND len >= 3 THEN [0, len // 3, 2 * len // 3, len] ELSE [0, len] END AS b FROM contigs), p AS (SELECT *, unnest(range(1, len(b))) AS i FROM b)
    SELECT tid, contig || CASE WHEN length(b) > 2 THEN '_s' || (i - 1) ELSE '' END AS contig, length(substr(seq, b[i] + 1, b[i + 1] - b[i]))::BIGINT AS n, md5(substr(seq, b[i] + 1, b[i + 1] - b[i])) AS md5 FROM p""")
def cut_contigs(spark, d):
    c = lens.contigs(spark, d)
    points = c.filter("tid % 3 = 0 and len >= 3").select("tid", F.explode(F.array(*[F.floor(F.col("len") * k / 3) for k in (1, 2)])).alias("point"))
    return splits.cut_contigs(c, points).select("tid", "contig", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("md5"))


@query(f"""WITH RECURSIVE {ALN}, dp AS (SELECT tid, count(*) AS depth FROM aln GROUP BY tid, pos), ct AS (SELECT tid, depth, count(*) AS c FROM dp GROUP BY ALL), r(tid, i, mean, go) AS (SELECT DISTINCT tid, 0, 3::BIGINT, true FROM ct UNION ALL
    SELECT tid, i + 1, m, m > mean FROM (SELECT r.tid, r.i, r.mean, coalesce((sum(depth * c) FILTER (depth < r.mean * 3) // nullif(sum(c) FILTER (depth < r.mean * 3), 0)), 0)::BIGINT AS m FROM r JOIN ct ON ct.tid = r.tid WHERE r.go AND r.i < 40 GROUP BY r.tid, r.i, r.mean))
    SELECT tid, mean FROM r QUALIFY row_number() OVER (PARTITION BY tid ORDER BY i DESC) = 1""")
def clipped_depth_mean(spark, d):
    return splits.clipped_mean(_aln(spark, d).groupBy("tid", "pos").agg(F.count(F.lit(1)).alias("depth")), start=3)


# Masks, targets, mates


@query()
def dust_regions(spark, d):
    return masks.dust_regions(lens.contigs(spark, d))


@query()
def unmasked_minimizers(spark, d):
    c = lens.contigs(spark, d).withColumn("seq", F.upper("seq"))
    return masks.drop_masked_seeds(seeds.minimizers(c, 15, 10).withColumnRenamed("i", "pos"), masks.dust_regions(c), 15)


@query()
def target_regions(spark, d):
    reads = _reads(spark, d)
    sites = pileup.majority_of(pileup.read_bases(reads)).filter("ins = 0").groupBy("tid", "pos").agg(F.max(F.col("base").isin(*"ACGT")).alias("called"))
    return masks.target_regions(sites, reads.groupBy("tid").agg(F.max(F.col("pos") + F.col("ref_len")).alias("len")), cost=200)


@query()
def mate_pairs(spark, d):
    a = _aln(spark, d).select("qname", "line", F.col("rid").alias("id"), "tid", F.col("pos").alias("beg"), (F.col("pos") + F.col("ref_len")).alias("end"), (F.col("flag").bitwiseAND(16) > 0).alias("reverse"), "score", "isize")
    odd, even = (a.filter(F.col("line") % 2 == k).drop("line", "isize") for k in (1, 0))
    rows = a.filter("isize > 0").select(F.when(F.col("reverse"), "FR").otherwise("FF").alias("orientation"), "isize")
    return masks.mate_pairs(odd, even, report.insert_statistics(rows, 8.0))


# Variant records


@query(f"""WITH {_VAR}, k AS (SELECT *, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 's' WHEN length(ref) < length(alt) THEN 'i' WHEN length(ref) > length(alt) THEN 'd' ELSE 'm' END AS k, (ref || alt) IN ('AG', 'GA', 'CT', 'TC') AS ts FROM va)
    SELECT chrom, count(*) AS n, count(*) FILTER (k = 's') AS snps, count(*) FILTER (k = 's' AND ts) AS ts, count(*) FILTER (k = 's' AND NOT ts) AS tv, count(*) FILTER (k = 'i') AS insertions, count(*) FILTER (k = 'd') AS deletions FROM k GROUP BY chrom""")
def variant_stats(spark, d):
    return variants.variant_stats(_variants(spark, d, 997, "p_size <= 30"))


@query("SELECT CASE WHEN a = '.' OR b = '.' THEN 'missing' WHEN a <> b THEN 'het' WHEN a = '0' THEN 'hom_ref' ELSE 'hom_alt' END AS class, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 3 THEN '.' ELSE (o_orderkey % 4)::VARCHAR END AS a, (o_custkey % 3)::VARCHAR AS b FROM orders) GROUP BY 1")
def genotype_classes(spark, d):
    a = F.when(F.col("o_orderkey") % 4 == 3, ".").otherwise((F.col("o_orderkey") % 4).cast("string"))
    o = lens.table(spark, d, "orders").select(variants.genotype_class(F.concat(a, F.lit("/"), (F.col("o_custkey") % 3).cast("string"))).alias("class"))
    return o.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_GT = "g AS (SELECT o_orderkey AS id, o_orderkey % 4 AS a, o_custkey % 3 AS b, o_custkey % 2 AS c FROM orders)"


@query(f"""WITH {_GT} SELECT id, concat_ws(',', CASE WHEN 1 IN (a, b) THEN 'C' END, CASE WHEN 2 IN (a, b) THEN 'G' END, CASE WHEN 3 IN (a, b) THEN 'T' END) AS alt,
    (CASE WHEN a = 0 THEN 0 ELSE (SELECT count(*) FROM unnest([1, 2, 3]) AS u(x) WHERE x <= a AND x IN (a, b)) END) || '|' || (CASE WHEN b = 0 THEN 0 ELSE (SELECT count(*) FROM unnest([1, 2, 3]) AS u(x) WHERE x <= b AND x IN (a, b)) END) AS gt FROM g""")
def trimmed_alleles(spark, d):
    text = lambda c, m: (F.col(c) % m).cast("string")
    first = F.array(F.concat(text("o_orderkey", 4), F.lit("|"), text("o_custkey", 3)), F.lit("9"))
    v = lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(*map(F.lit, "CGT")).alias("alt"), F.array(F.array(text("o_custkey", 2), F.lit("1")), first).alias("samples"))
    out = variants.trim_alleles(variants.subset_samples(v, [1]))
    return out.select("id", F.array_join("alt", ",").alias("alt"), F.col("samples")[0][0].alias("gt"))
