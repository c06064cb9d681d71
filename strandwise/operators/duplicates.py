"""Mates and duplicates: grouped winners, so that no key needs a sort of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg
from strandwise.functions.flags import has, none_of


def quality_score(qual: Column, least: int = 15) -> Column:
    """The sum of the base qualities of at least least."""
    return F.aggregate(F.filter(qual, lambda q: q >= least), F.lit(0).cast("long"), lambda a, q: a + q)


def pairs(aln: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """qname, a_<column>, b_<column>: first and second reads of templates that have both, primary records only. A
    template with more than one of either gives its first by rid."""
    primary = aln.filter(none_of(F.col("flag"), 0x900) & has(F.col("flag"), "PAIRED"))
    pick = lambda bit, p: F.min(F.when(has(F.col("flag"), bit), F.struct("rid", *[F.col(c).alias(f"_{c}") for c in columns]))).alias(p)
    both = primary.groupBy("qname").agg(pick("READ1", "a"), pick("READ2", "b")).filter("a is not null and b is not null")
    return both.select("qname", *[F.col(f"{p}.{'rid' if c == 'rid' else '_' + c}").alias(f"{p}_{c}") for p in "ab" for c in ("rid", *[x for x in columns if x != "rid"])])


def fixmate(aln: DataFrame) -> DataFrame:
    """aln(rid, qname, flag, tid, pos, mapq, cigar, score) -> rid, qname, flag, tid, pos, mtid, mpos, isize, MQ, ms.

    For the two primary reads of a template: an unmapped read takes its mate's place, mate strand and mate-unmapped bits
    follow the mate, isize is the distance of the 5' ends if both map to one contig, MQ is the mate's mapq and ms the
    mate's score. Other records keep their values, with nulls for the mate's.
    """
    p = pairs(aln, ("flag", "tid", "pos", "mapq", "cigar", "score"))
    side = lambda me, mate: p.select(F.col(f"{me}_rid").alias("rid"), *[F.col(f"{mate}_{c}").alias(f"m_{c}") for c in ("flag", "tid", "pos", "mapq", "cigar", "score")])
    mates = side("a", "b").unionByName(side("b", "a"))
    rows = aln.join(mates, "rid", "left")
    unmapped, m_unmapped, with_mate = has(F.col("flag"), "UNMAP"), has(F.col("m_flag"), "UNMAP"), F.col("m_flag").isNotNull()
    tid = F.when(with_mate & unmapped & ~m_unmapped, F.col("m_tid")).otherwise(F.col("tid"))
    pos = F.when(with_mate & unmapped & ~m_unmapped, F.col("m_pos")).otherwise(F.col("pos"))
    m_tid = F.when(with_mate & m_unmapped & ~unmapped, F.col("tid")).otherwise(F.col("m_tid"))
    m_pos = F.when(with_mate & m_unmapped & ~unmapped, F.col("pos")).otherwise(F.col("m_pos"))
    five = lambda f, q, c: F.when(has(f, "REVERSE"), q + cg.reference_span(c)).otherwise(q)
    own5, mate5 = five(F.col("flag"), F.col("pos"), F.col("cigar")), five(F.col("m_flag"), F.col("m_pos"), F.col("m_cigar"))
    isize = F.when(with_mate & ~unmapped & ~m_unmapped & (F.col("tid") == F.col("m_tid")), mate5 - own5).when(with_mate, F.lit(0))
    bits = F.when(with_mate, F.col("flag").bitwiseAND(F.lit(~(0x20 | 0x8))) + F.when(has(F.col("m_flag"), "REVERSE"), 0x20).otherwise(0) + F.when(m_unmapped, 0x8).otherwise(0)).otherwise(F.col("flag"))
    return rows.select("rid", "qname", bits.alias("flag"), tid.alias("tid"), pos.alias("pos"), m_tid.alias("mtid"), m_pos.alias("mpos"), isize.cast("long").alias("isize"), F.col("m_mapq").alias("MQ"), F.col("m_score").alias("ms"))


def proper_pair(flag: Column, tid: Column, mtid: Column, pos: Column, mpos: Column) -> Column:
    """Both on one contig, facing each other."""
    reverse, mate_reverse = has(flag, "REVERSE"), has(flag, "MREVERSE")
    facing = F.when(pos <= mpos, ~reverse & mate_reverse).otherwise(reverse & ~mate_reverse)
    return none_of(flag, 0xC) & (tid == mtid) & facing


def five_prime(flag: Column, pos: Column, cigar: Column) -> Column:
    """The unclipped 5' end: the end for reverse reads."""
    return F.when(has(flag, "REVERSE"), cg.unclipped_end(pos, cigar)).otherwise(cg.unclipped_start(pos, cigar))


def markdup_single(aln: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """aln(rid, flag, tid, pos, cigar, score) with duplicate: of primary mapped reads with one 5' end and strand all
    but the best are duplicates; higher score wins, then the smaller rid. extra: more columns of the key.

    The best is a grouped maximum, joined back: a place with many reads combines before it is sent.
    """
    rows = aln.withColumn("_use", none_of(F.col("flag"), 0xB04)).withColumn("_five", five_prime(F.col("flag"), F.col("pos"), F.col("cigar"))).withColumn("_rev", has(F.col("flag"), "REVERSE"))
    keys = ["tid", "_five", "_rev", *extra]
    best = rows.filter("_use").groupBy(*keys).agg(F.min(F.struct(F.negate("score").alias("s"), "rid"))["rid"].alias("_best"))
    return rows.join(best, keys, "left").withColumn("duplicate", F.coalesce(F.col("_use") & (F.col("rid") != F.col("_best")), F.lit(False))).select(*aln.columns, "duplicate")


def markdup(aln: DataFrame) -> DataFrame:
    """aln(rid, qname, flag, tid, pos, cigar, score) -> rid, qname, duplicate, for primary mapped reads that passed.

    Pairs are told by both 5' ends and the orientation; the higher sum of both scores survives, then the smaller name.
    A read without a mapped mate is a duplicate if any paired read has its end, else all but the best of the singles.
    """
    use = aln.filter(none_of(F.col("flag"), 0xB04)).withColumn("five", five_prime(F.col("flag"), F.col("pos"), F.col("cigar"))).withColumn("rev", has(F.col("flag"), "REVERSE").cast("int"))
    p = pairs(use, ("tid", "five", "rev", "score"))
    a, b = F.struct(F.col("a_tid").alias("tid"), F.col("a_five").alias("five"), F.col("a_rev").alias("rev")), F.struct(F.col("b_tid").alias("tid"), F.col("b_five").alias("five"), F.col("b_rev").alias("rev"))
    keyed = p.select("qname", "a_rid", "b_rid", F.least(a, b).alias("k1"), F.greatest(a, b).alias("k2"), (F.col("a_score") + F.col("b_score")).alias("sum"), a.alias("ka"), b.alias("kb"))
    best = keyed.groupBy("k1", "k2").agg(F.min(F.struct(F.negate("sum").alias("s"), "qname"))["qname"].alias("best"))
    judged = keyed.join(best, ["k1", "k2"]).withColumn("duplicate", F.col("qname") != F.col("best"))
    paired = judged.select(F.explode(F.array("a_rid", "b_rid")).alias("rid"), "qname", "duplicate")
    ends = keyed.select(F.explode(F.array("ka", "kb")).alias("k")).select("k.*").distinct().withColumn("taken", F.lit(True))
    singles = use.join(paired.select("rid"), "rid", "left_anti").join(ends, ["tid", "five", "rev"], "left")
    first = singles.groupBy("tid", "five", "rev").agg(F.min(F.struct(F.negate("score").alias("s"), "rid"))["rid"].alias("best"))
    alone = singles.join(first, ["tid", "five", "rev"]).select("rid", "qname", (F.coalesce("taken", F.lit(False)) | (F.col("rid") != F.col("best"))).alias("duplicate"))
    return paired.unionByName(alone)


def mark_supplementary(aln: DataFrame, marked: DataFrame) -> DataFrame:
    """Supplementary and secondary records of names that have a duplicate: rid, qname, duplicate."""
    names = marked.filter("duplicate").select("qname").distinct().withColumn("_d", F.lit(True))
    others = aln.filter(~none_of(F.col("flag"), 0x900)).select("rid", "qname")
    return others.join(names, "qname", "left").select("rid", "qname", F.coalesce("_d", F.lit(False)).alias("duplicate"))


def legacy_rmdup(aln: DataFrame, single: bool = True) -> DataFrame:
    """The older rule: of reads of one library at one position (and strand) the one of best mapq stays; rid, kept."""
    keys = ["lib", "tid", "pos", *(["_rev"] if single else ["isize"])]
    rows = aln.filter(none_of(F.col("flag"), 0x904)).withColumn("_rev", has(F.col("flag"), "REVERSE"))
    best = rows.groupBy(*keys).agg(F.min(F.struct(F.negate("mapq").alias("m"), "rid"))["rid"].alias("_best"))
    return rows.join(best, keys).select("rid", (F.col("rid") == F.col("_best")).alias("kept"))
