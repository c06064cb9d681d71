"""Recurrences over aggregated sites: score chains, phasing, best paths, and the choices of alleles and haplotypes.

Only these run outside the JVM, and only on counts: a group holds the counted cells of one window of a contig, whose
number follows the window's width, not the depth. Windows overlap and are stitched afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import letters

#: The penalty of a site's reads: short and long.
SHORT, LONG = 0.5, 0.33


def chain_sites(sites: list[tuple[tuple[int, int], list[tuple[str, int, bool]]]], r: float = SHORT) -> list[tuple[int, int, str, int, int]]:
    """The best chain through sites in order: (pos, ins, base, n of that base, all).

    sites: ((pos, ins), [(kmer, count, is the contig's own), ...] in the order first seen). A 3-mer's score is the score
    so far of its middle base at the site before (of the best base, if there is none or it isn't there), plus its count,
    less r times all counts; the contig's own observation is left out of both if there are others. Each base keeps its
    first best 3-mer. From the best last base the middle bases lead back.
    """
    before: dict[str, float] = {}
    kept: list[dict[str, tuple[float, str]]] = []
    for _, seen in sites:
        total = sum(n for _, n, _ in seen)
        less = total - 1 if total > 1 else total
        top = max(before.values(), default=0.0)
        now: dict[str, tuple[float, str]] = {}
        for kmer, n, own in seen:
            count = n - 1 if own and total > 1 else n
            s = before.get(kmer[1], top) + count - less * r
            if kmer[2] not in now or s > now[kmer[2]][0]:
                now[kmer[2]] = (s, kmer[1])
        kept.append(now)
        before = {b: s for b, (s, _) in now.items()}
    out = []
    base = None
    for (at, seen), now in zip(reversed(sites), reversed(kept)):
        if base is None or base not in now:
            base = max(now, key=lambda b: now[b][0])
        out.append((*at, base, sum(n for k, n, _ in seen if k[2] == base), sum(n for _, n, _ in seen)))
        base = now[base][1]
    return out[::-1]


def score_chain(counts: DataFrame, r: float = SHORT, least_share: float = 0.8, keys: tuple[str, ...] = ("tid",)) -> DataFrame:
    """counts(keys, pos, ins, kmer, n, first_rid, own) -> keys, pos, ins, base, n, total, zero, low: the chain of each
    group. zero: the contig alone is seen there; low: the base's share is small. own marks the contig's 3-mer."""
    names = [*keys, "pos", "ins", "base", "n", "total"]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "ins", "first_rid", "kmer"], kind="stable")
        sites: list = []
        for pos, ins, kmer, n, own in zip(pdf["pos"], pdf["ins"], pdf["kmer"], pdf["n"], pdf["own"]):
            if not sites or sites[-1][0] != (pos, ins):
                sites.append(((pos, ins), []))
            sites[-1][1].append((kmer, int(n), bool(own)))
        return pd.DataFrame([(*key, *row) for row in chain_sites(sites, r)], columns=names)

    schema = ", ".join(f"{k} bigint" for k in keys) + ", pos bigint, ins int, base string, n bigint, total bigint"
    chained = counts.select(*keys, "pos", "ins", "kmer", "n", "first_rid", "own").groupBy(*keys).applyInPandas(each, schema)
    return chained.withColumn("zero", F.col("total") == 1).withColumn("low", (F.col("n") / F.col("total") < least_share) & (F.col("total") > 1))


def contig_cells(contigs: DataFrame, inserted: DataFrame) -> DataFrame:
    """The contig itself as read -1: rid, tid, pos, ins, base; '-' in the columns inserted(tid, pos, columns)."""
    own = contigs.filter("length(seq) > 0").select("tid", F.posexplode(letters(F.upper("seq"))).alias("pos", "base")).select(F.lit(-1).cast("long").alias("rid"), "tid", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("ins"), "base")
    gaps = inserted.select(F.lit(-1).cast("long").alias("rid"), "tid", "pos", F.explode(F.sequence(F.lit(1), F.col("columns"))).alias("ins"), F.lit("-").alias("base"))
    return own.unionByName(gaps)


def with_contig(walked: DataFrame, contigs: DataFrame) -> DataFrame:
    """walked(rid, tid, pos, ins, base) and the contig itself as read -1, which shows '-' in inserted columns."""
    columns = walked.filter("ins > 0").groupBy("tid", "pos").agg(F.max("ins").alias("columns"))
    return walked.select("rid", "tid", "pos", "ins", "base").unionByName(contig_cells(contigs, columns))


#: Positions of a contig that are looked at together; each part begins with the two columns before it.
_PART = 65536


def _with_before(cells: DataFrame) -> DataFrame:
    """cells(rid, tid, pos, ins, base) with _p and _pp, the two cells before, by a window over each read, and over the
    contig (rid -1) in parts."""
    part = F.when(F.col("rid") < 0, F.floor(F.col("pos") / _PART))
    order = Window.partitionBy("rid", "tid", "_part").orderBy("pos", "ins")
    both = cells.withColumn("_part", part).withColumn("_own", F.lit(True))
    # A part's last positions come again before the next one: three letters are enough, whatever is inserted there.
    again = both.filter((F.col("rid") < 0) & (F.col("pos") % _PART >= _PART - 2)).withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False))
    rows = both.unionByName(again)
    cell = F.struct("pos", "ins", "base")
    return rows.withColumn("_p", F.lag(cell, 1).over(order)).withColumn("_pp", F.lag(cell, 2).over(order)).filter("_own").drop("_own", "_part")


def _cell_kmers(cells: DataFrame) -> DataFrame:
    """cells -> rid, tid, pos, ins, kmer."""
    before = lambda c: F.coalesce(F.col(f"{c}.base"), F.lit("."))
    return _with_before(cells).select("rid", "tid", "pos", "ins", F.concat(before("_pp"), before("_p"), F.col("base")).alias("kmer"))


def contig_positional_kmers(contigs: DataFrame, inserted: DataFrame) -> DataFrame:
    """The contig's own rows of read_positional_kmers."""
    rows = _with_before(contig_cells(contigs, inserted))
    return rows.select("rid", "tid", "pos", "ins", "base", *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in ("p", "pp") for c in ("pos", "ins", "base")])


def counted_kmers(walked: DataFrame) -> DataFrame:
    """with_contig's rows -> tid, pos, ins, kmer, n, first_rid, own."""
    return _counted(_cell_kmers(walked))


def _counted(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("tid", "pos", "ins", "kmer").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"), F.max(F.col("rid") < 0).alias("own"))


def counted_read_kmers(aln: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same of alignments without padding: a read's 3-mers are made within its row, so that only counts and the
    contigs' own cells are shuffled. aln(rid, tid, pos, cigar, seq), contigs(tid, seq)."""
    from strandwise.operators import pileup

    columns = pileup.read_insertions(aln)
    own = _counted(_cell_kmers(contig_cells(contigs, columns)))
    both = pileup.kmer3(aln).withColumn("own", F.lit(False)).unionByName(own)
    return both.groupBy("tid", "pos", "ins", "kmer").agg(F.sum("n").alias("n"), F.min("first_rid").alias("first_rid"), F.max("own").alias("own"))


def windowed(counts: DataFrame, width: int, overlap: int) -> DataFrame:
    """counts in windows of that width: rows in an overlap are in both, told by win."""
    step = width - overlap
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - width) / step) + 1)
    return counts.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("pos") / step)))).filter(F.col("pos") < F.col("win") * step + width)


# Haplotypes of regions


def region_haplotypes(aln: DataFrame, regions: DataFrame) -> DataFrame:
    """aln(rid, tid, pos, cigar, seq, beg, end, mapq[, qual]), regions(tid, beg, end) -> tid, beg, end, hap, num,
    mapq_sum, qual_sum, first_rid: what the reads that span a region show in it. The region is cut out of the read's row
    by its CIGAR; no column of the pile-up is made."""
    from strandwise.functions import cigar as cg
    from strandwise.operators.ranges import contains_join

    ops = F.filter(cg.with_offsets(F.col("cigar")), lambda x: x["op"].isin("M", "=", "X", "I") & (x["len"] > 0))
    qual = F.col("qual").cast("array<int>") if "qual" in aln.columns else F.lit(None).cast("array<int>")
    rows = aln.select("rid", "tid", "beg", "end", "mapq", "pos", "seq", qual.alias("_qual"), ops.alias("_ops"))
    spanning = contains_join(rows, regions.select("tid", "beg", "end"))

    def part(o: Column) -> Column:
        """Where the operation's letters of the region begin in the read, and how many they are."""
        at = F.col("pos") + o["r"]
        low, high = F.greatest(at, F.col("r_beg")), F.least(at + o["len"], F.col("r_end"))
        inside = (at - 1 >= F.col("r_beg")) & (at - 1 < F.col("r_end"))  # inserted letters belong to the position before
        ins = o["op"] == "I"
        n = F.when(ins, F.when(inside, o["len"]).otherwise(0)).otherwise(F.greatest(high - low, F.lit(0)))
        return F.struct(F.when(ins, o["q"]).otherwise(o["q"] + low - at).cast("int").alias("q"), n.cast("int").alias("n"))

    parts = F.filter(F.transform("_ops", part), lambda x: x["n"] > 0)
    cut = spanning.select("rid", "tid", F.col("r_beg").alias("beg"), F.col("r_end").alias("end"), "mapq", "seq", "_qual", parts.alias("_p"))
    hap = F.upper(F.array_join(F.transform("_p", lambda x: F.substring(F.col("seq"), x["q"] + 1, x["n"])), ""))
    quals = F.flatten(F.transform("_p", lambda x: F.slice("_qual", x["q"] + 1, x["n"])))
    mean = F.aggregate(quals, F.lit(0.0), lambda a, q: a + q) / F.when(F.size(quals) > 0, F.size(quals))
    shown = cut.select("rid", "tid", "beg", "end", "mapq", hap.alias("hap"), F.floor(mean).alias("_q"))
    grouped = shown.groupBy("tid", "beg", "end", "hap")
    return grouped.agg(F.count(F.lit(1)).alias("num"), F.sum("mapq").cast("long").alias("mapq_sum"), F.sum("_q").cast("long").alias("qual_sum"), F.min("rid").alias("first_rid"))


def best_haplotypes(haps: DataFrame, all_best: int = 3000) -> DataFrame:
    """Of each region the haplotype of most reads, then mapping quality, then base quality, then first seen. One whose
    mapping qualities sum to all_best (50 reads of 60) comes first."""
    order = Window.partitionBy("tid", "beg", "end").orderBy((F.col("mapq_sum") == all_best).desc(), F.desc("num"), F.desc("mapq_sum"), F.desc("qual_sum"), "first_rid")
    return haps.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def limited_observations(reads: DataFrame, keys: list[str], most: int = 50, mapq: int = 60) -> DataFrame:
    """reads(keys, rid, mapq) of each region up to the one with which most reads of that mapping quality are seen."""
    order = Window.partitionBy(*keys).orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("mapq") == mapq, 1).otherwise(0)).over(order), F.lit(0))
    return reads.withColumn("_s", seen).filter(F.col("_s") < most).drop("_s")


# Variants and phasing


def call_snps(counts: DataFrame, reference: DataFrame, low: float = 0.34, least: int = 5) -> DataFrame:
    """counts(tid, pos, base, n, first_rid), reference(tid, pos, base) -> tid, pos, ref, first, second, n1, n2, call.

    call: 0 keep, 1 heterozygous, 2 replace. rate is n2 / n1. Keep if it is below low and the top is the contig's base;
    replace if it is 0, or the top has least reads, is another base and the rate is below low; else heterozygous.
    """
    order = Window.partitionBy("tid", "pos").orderBy(F.desc("n"), "first_rid", "base")
    ranked = counts.withColumn("_k", F.row_number().over(order)).filter("_k <= 2")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    top = ranked.groupBy("tid", "pos").agg(at(1, "base").alias("first"), at(2, "base").alias("second"), at(1, "n").alias("n1"), F.coalesce(at(2, "n"), F.lit(0)).alias("n2"))
    joined = top.join(reference.select("tid", "pos", F.upper("base").alias("ref")), ["tid", "pos"])
    rate, same = F.col("n2") / F.col("n1"), F.col("first") == F.col("ref")
    call = F.when((rate < low) & same, 0).when((rate == 0) | ((F.col("n1") >= least) & ~same & (rate < low)), 2).otherwise(1)
    return joined.select("tid", "pos", "ref", "first", "second", "n1", "n2", call.alias("call"))


def snp_links(aln: DataFrame, snps: DataFrame, width: int = 1024) -> DataFrame:
    """aln(rid, tid, pos, cigar, seq, beg, end, mapq[, qual]), snps(tid, pos, first, second) -> tid, pos, prev_pos,
    prev_allele, allele, num, mapq_sum, qual_sum: alleles (0 or 1) that reads show at neighbouring sites.

    The SNPs of a stretch of a contig are one row; reads meet the stretches that they touch, and read their bases off
    their CIGARs, so what is shuffled are reads and not their columns.
    """
    from strandwise.functions import cigar as cg

    ops = F.filter(cg.with_offsets(F.col("cigar")), lambda x: x["op"].isin("M", "=", "X", "D") & (x["len"] > 0))
    qual = F.col("qual").cast("array<int>") if "qual" in aln.columns else F.lit(None).cast("array<int>")
    stretch = F.sequence(F.floor(F.col("beg") / width), F.floor((F.greatest(F.col("end"), F.col("beg") + 1) - 1) / width))
    reads = aln.select("rid", "tid", "mapq", "pos", "seq", qual.alias("_qual"), ops.alias("_ops"), F.explode(stretch).alias("_bin"))
    sites = snps.groupBy("tid", F.floor(F.col("pos") / width).alias("_bin")).agg(F.array_sort(F.collect_list(F.struct("pos", "first", "second"))).alias("_snps"))  # width at most

    def shown(o: Column) -> Column:
        """What the read shows at the SNPs that the operation covers: (pos, allele, qual)."""
        at = F.col("pos") + o["r"]
        here = F.filter("_snps", lambda x: (x["pos"] >= at) & (x["pos"] < at + o["len"]))

        def one(x: Column) -> Column:
            q = (o["q"] + x["pos"] - at).cast("int")
            gap = o["op"] == "D"
            base = F.when(gap, F.lit("-")).otherwise(F.upper(F.substring(F.col("seq"), q + 1, F.lit(1))))
            allele = F.when(base == x["first"], 0).when(base == x["second"], 1)
            return F.struct(x["pos"].alias("pos"), allele.alias("allele"), F.when(~gap, F.get("_qual", q)).alias("qual"))

        return F.filter(F.transform(here, one), lambda x: x["allele"].isNotNull())

    met = reads.join(sites, ["tid", "_bin"]).select("rid", "tid", "mapq", F.flatten(F.transform("_ops", shown)).alias("_a"))
    per = met.groupBy("rid", "tid", "mapq").agg(F.array_sort(F.flatten(F.collect_list("_a"))).alias("_a"))  # one read's own
    pairs = F.transform(F.col("_a"), lambda x, i: F.struct(x.alias("x"), F.get("_a", i - 1).alias("p")))
    linked = per.select("tid", "mapq", F.explode(pairs).alias("_l")).filter("_l.p is not null")
    linked = linked.select("tid", "mapq", F.col("_l.x.pos").alias("pos"), F.col("_l.p.pos").alias("prev_pos"), F.col("_l.p.allele").alias("prev_allele"), F.col("_l.x.allele").alias("allele"), F.col("_l.x.qual").alias("qual"))
    return linked.groupBy("tid", "pos", "prev_pos", "prev_allele", "allele").agg(F.count(F.lit(1)).alias("num"), F.sum("mapq").cast("long").alias("mapq_sum"), F.coalesce(F.sum("qual"), F.lit(0)).cast("long").alias("qual_sum"))


def link_score(num: int, mapq_sum: int, qual_sum: int, total: int, ploidy: int = 2) -> float:
    return num * math.log10((mapq_sum + qual_sum) / num + 2) - total / ploidy if num else -total / ploidy


def phase_sites(sites: list[int], links: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int, int]]]) -> list[tuple[int, int, float]]:
    """sites in order; links[prev, pos][prev allele, allele] = (num, Σ mapping, Σ base quality) -> (site, allele of the
    first haplotype, score so far). Two states, one for each allele on the first haplotype; the second haplotype has the
    other. A site without links to the one before begins anew with the more frequent allele."""
    out: list[tuple[int, int, float]] = []
    scores, trace = [(0.0, 0.0)], [(0, 0)]
    for prev, pos in zip(sites, sites[1:]):
        seen = links.get((prev, pos), {})
        total = sum(n for n, _, _ in seen.values())
        one = {(a, b): link_score(*seen.get((a, b), (0, 0, 0)), total) for a in (0, 1) for b in (0, 1)} if seen else dict.fromkeys([(a, b) for a in (0, 1) for b in (0, 1)], 0.0)
        now, back = [], []
        for b in (0, 1):
            ways = [scores[-1][a] + one[a, b] + one[1 - a, 1 - b] for a in (0, 1)]
            best = 1 if ways[1] > ways[0] else 0
            if not seen:
                best = 1 if scores[-1][1] > scores[-1][0] else 0
                ways[best] = scores[-1][best] - (1e-9 if b else 0.0)
            now.append(ways[best])
            back.append(best)
        scores.append(tuple(now))
        trace.append(tuple(back))
    state = 1 if scores[-1][1] > scores[-1][0] else 0
    for i in range(len(sites) - 1, -1, -1):
        out.append((sites[i], state, scores[i][state]))
        state = trace[i][state]
    return out[::-1]


def phase(snps: DataFrame, links: DataFrame) -> DataFrame:
    """snps(tid, pos), links (snp_links) -> tid, pos, allele, score: one consistent haplotype of each contig."""
    rows = snps.select("tid", "pos").join(links, ["tid", "pos"], "left")

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for r in pdf.dropna(subset=["prev_pos"]).itertuples(index=False):
            found.setdefault((int(r.prev_pos), int(r.pos)), {})[int(r.prev_allele), int(r.allele)] = (int(r.num), int(r.mapq_sum), int(r.qual_sum))
        rows = phase_sites(sorted(set(int(p) for p in pdf["pos"])), found)
        return pd.DataFrame([(*key, p, a, round(s, 6)) for p, a, s in rows], columns=["tid", "pos", "allele", "score"])

    return rows.groupBy("tid").applyInPandas(each, "tid bigint, pos bigint, allele int, score double")


# Best path over positional 3-mers (long reads)

#: What a read of coverage costs by read type.
COVERAGE_COST = {"ont": 3, "clr": 3, "hifi": 4}
#: Least quality of an upper-case base by read type.
UPPER_QUALITY = {"ont": 20, "clr": 20, "hifi": 80}

Cell = tuple[int, int, str]


def best_path(edges: list[tuple[Cell, Cell | None, Cell | None, int]], coverage: dict[int, int], read_type: str = "ont") -> list[tuple[int, int, str, int]]:
    """edges: (cell, the one before, the one before that, reads) -> cells of the best path, with the reads of its edges.

    An edge scores 10 times its reads less the read type's cost of the coverage at its position, on top of the best edge
    that its last two cells continue. The path ends at the best cell of the last position, the later one on ties. Ties
    between edges: clr and hifi prefer one that doesn't come from a gap, ont the one with more reads, then the same base.
    """
    cost = COVERAGE_COST[read_type]
    order = sorted(edges, key=lambda e: (e[0][0], e[0][1]))
    score: dict[tuple, tuple] = {}  # of (cell, before): score, rank, the pair before it, reads
    for cell, before, earlier, n in order:
        own = 10 * n - cost * coverage.get(cell[0], 0)
        past = score.get((before, earlier)) if before is not None else None
        s = own + (past[0] if past else 0)
        rank = (n, before is not None and before[2] == cell[2]) if read_type == "ont" else (before is not None and before[2] != "-", n)
        had = score.get((cell, before))
        if had is None or (s, rank) > had[:2]:
            score[cell, before] = (s, rank, (before, earlier) if past else None, n)
    if not score:
        return []
    last = max(c[0] for c, _ in score)
    at = max((k for k in score if k[0][0] == last), key=lambda k: (score[k][0], k[0][1], k[0][2]))
    out = []
    while at is not None:
        out.append((*at[0], score[at][3]))
        at = score[at][2]
    return out[::-1]


def msa_consensus(edges: DataFrame, coverage: DataFrame, read_type: str = "ont", keys: tuple[str, ...] = ("tid",)) -> DataFrame:
    """edges (positional_kmer3 with keys), coverage(keys, pos, coverage) -> keys, pos, ins, base, qv, low: the best path
    without its gaps. qv is 100 times the reads of the edge over the coverage; low if that or the coverage is small."""
    rows = edges.join(coverage.select(*keys, "pos", "coverage"), [*keys, "pos"], "left")
    names = [*keys, "pos", "ins", "base", "qv", "low"]
    upper = UPPER_QUALITY[read_type]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = lambda p, i, b: None if pd.isna(p) else (int(p), int(i), b)
        es = [(cell(r.pos, r.ins, r.base), cell(r.p_pos, r.p_ins, r.p_base), cell(r.pp_pos, r.pp_ins, r.pp_base), int(r.n)) for r in pdf.itertuples(index=False)]
        cov = {int(p): int(c) for p, c in zip(pdf["pos"], pdf["coverage"].fillna(0))}
        out = []
        for pos, ins, base, n in best_path(es, cov, read_type):
            if base != "-":
                c = max(cov.get(pos, 0), 1)
                out.append((*key, pos, ins, base, 100 * n // c, not (c > 4 and 100 * n // c > upper)))
        return pd.DataFrame(out, columns=names)

    schema = ", ".join(f"{k} bigint" for k in keys) + ", pos bigint, ins int, base string, qv bigint, low boolean"
    return rows.groupBy(*keys).applyInPandas(each, schema)


# Partial-order alignment of a few sequences


def poa(sequences: list[str], match: int = 1, mismatch: int = -2, gap: int = -2) -> str:
    """The consensus of a few sequences: each is aligned to the graph of those before (global), the graph's edges count
    the sequences that take them, and the heaviest path, in which a node loses half for each edge that enters it, wins."""
    seqs = [s for s in sequences if s]
    if not seqs:
        return ""
    base, out_edges, aligned = [], [], []

    def node(b: str) -> int:
        base.append(b)
        out_edges.append({})
        aligned.append(set())
        return len(base) - 1

    def topological() -> list[int]:
        into = [0] * len(base)
        for es in out_edges:
            for t in es:
                into[t] += 1
        ready, order = [i for i, n in enumerate(into) if not n], []
        while ready:
            i = ready.pop()
            order.append(i)
            for t in out_edges[i]:
                into[t] -= 1
                if not into[t]:
                    ready.append(t)
        return order

    def thread(path: list[int]) -> None:
        for a, b in zip(path, path[1:]):
            out_edges[a][b] = out_edges[a].get(b, 0) + 1

    thread([node(b) for b in seqs[0]])
    for s in seqs[1:]:
        order = topological()
        enter: list[list[int]] = [[] for _ in base]
        for a, es in enumerate(out_edges):
            for b in es:
                enter[b].append(a)
        m = len(s)
        rows: dict[int, list[int]] = {-1: [gap * j for j in range(m + 1)]}
        move: dict[tuple[int, int], tuple[int, int]] = {(-1, j): (-1, j - 1) for j in range(1, m + 1)}
        for v in order:
            best, row = enter[v] or [-1], []
            for j in range(m + 1):
                ways = [(rows[u][j] + gap, (u, j)) for u in best]
                if j:
                    w = match if base[v] == s[j - 1] else mismatch
                    ways = [(rows[u][j - 1] + w, (u, j - 1)) for u in best] + ways + [(row[j - 1] + gap, (v, j - 1))]
                top = max(ways, key=lambda x: x[0])
                row.append(top[0])
                move[v, j] = top[1]
            rows[v] = row
        at = (max((v for v in order if not out_edges[v]), key=lambda v: rows[v][m]), m)
        path: list[int] = []
        while at != (-1, 0):
            u, j = move[at]
            if j < at[1]:
                c = s[at[1] - 1]
                if u != at[0]:  # node against base
                    v = at[0]
                    same = [x for x in (v, *aligned[v]) if base[x] == c]
                    if same:
                        path.append(same[0])
                    else:
                        new = node(c)
                        group = {v, *aligned[v]}
                        for x in group:
                            aligned[x].add(new)
                        aligned[new] = group
                        path.append(new)
                else:
                    path.append(node(c))
            at = (u, j)
        thread(path[::-1])
    order = topological()
    entering = [0] * len(base)
    for es in out_edges:
        for t in es:
            entering[t] += 1
    weight = {v: (0.0, -1) for v in order}
    for v in order:
        for t, n in out_edges[v].items():
            w = weight[v][0] + n - 0.5 * entering[t]
            if weight[t][1] < 0 or w > weight[t][0]:
                weight[t] = (w, v)
    at = max((v for v in order if not out_edges[v]), key=lambda v: weight[v][0])
    text = []
    while at >= 0:
        text.append(base[at])
        at = weight[at][1]
    return "".join(reversed(text))


def poa_consensus(groups: DataFrame, column: str = "seqs", most: int = 6) -> DataFrame:
    """groups(..., seqs array) with consensus. Of longer lists the first most are taken, as their order says."""

    @F.pandas_udf("string")
    def each(seqs: pd.Series) -> pd.Series:
        return pd.Series([poa(list(s)[:most]) if s is not None else None for s in seqs])

    return groups.withColumn("consensus", each(column))


def prune_candidates(candidates: DataFrame, most: int = 30) -> DataFrame:
    """candidates(region, cid, seq, score): without those over twice the median length, over 1.4 times the next longer,
    below a tenth of the best score or half the one before it in order of score; at most most of a region."""
    n = F.length("seq")
    w = Window.partitionBy("region")
    rows = candidates.withColumn("_n", n).withColumn("_med", F.percentile("_n", F.lit(0.5)).over(w)).withColumn("_top", F.max("score").over(w))
    rows = rows.withColumn("_less", F.lag("_n").over(w.orderBy("_n", "cid"))).withColumn("_prev", F.lag("score").over(w.orderBy(F.desc("score"), "cid")))
    good = (F.col("_n") <= 2 * F.col("_med")) & (F.col("_less").isNull() | (F.col("_n") <= 1.4 * F.col("_less"))) & (F.col("score") >= 0.1 * F.col("_top")) & (F.col("_prev").isNull() | (F.col("score") >= 0.5 * F.col("_prev")))
    kept = rows.filter(good).withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "cid"))).filter(F.col("_k") <= most)
    return kept.select(*candidates.columns)


def identical_vote(candidates: DataFrame) -> DataFrame:
    """candidates(region, seq) -> region, seq, n: the most frequent sequence, the longer on ties, then the smaller."""
    n = candidates.groupBy("region", "seq").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("region").orderBy(F.desc("n"), F.desc(F.length("seq")), "seq")
    return n.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def update_sites(sites: DataFrame, new: DataFrame, flag: Column | None = None) -> DataFrame:
    """sites(tid, pos, ins, base, low) with the base and low of new where new has the site, and low set by flag."""
    n = new.select("tid", "pos", "ins", F.col("base").alias("_b"), F.col("low").alias("_l"))
    out = sites.join(n, ["tid", "pos", "ins"], "left").withColumn("base", F.coalesce("_b", "base")).withColumn("low", F.coalesce("_l", "low")).drop("_b", "_l")
    return out if flag is None else out.withColumn("low", flag)


def anchors(sites: DataFrame, width: int = 4096) -> DataFrame:
    """sites(tid, pos, snp) -> tid, pos, left, right of the SNPs: the nearest sites that aren't any. Stretches of a contig
    are looked at on their own; beyond them the last and first plain sites of the stretches around decide."""
    rows = sites.select("tid", "pos", "snp", F.floor(F.col("pos") / width).alias("_bin"))
    plain = F.when(~F.col("snp"), F.col("pos"))
    ends = rows.groupBy("tid", "_bin").agg(F.max(plain).alias("_last"), F.min(plain).alias("_first"))
    up, down = Window.partitionBy("tid").orderBy("_bin"), Window.partitionBy("tid").orderBy(F.desc("_bin"))  # a row for width sites
    beyond = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("tid", "_bin", F.last("_last", ignorenulls=True).over(beyond(up)).alias("_l"), F.last("_first", ignorenulls=True).over(beyond(down)).alias("_r"))
    w, back = Window.partitionBy("tid", "_bin").orderBy("pos"), Window.partitionBy("tid", "_bin").orderBy(F.desc("pos"))  # both run forward
    near = rows.withColumn("_ol", F.last(plain, ignorenulls=True).over(beyond(w))).withColumn("_or", F.last(plain, ignorenulls=True).over(beyond(back))).filter("snp")
    return near.join(ends, ["tid", "_bin"]).select("tid", "pos", F.coalesce("_ol", "_l").alias("left"), F.coalesce("_or", "_r").alias("right"))


TaskFunction = Callable[..., DataFrame]
