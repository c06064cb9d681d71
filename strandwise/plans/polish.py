"""Polishing: each task maps reads to the contigs, rebuilds their sequence, and hands it to the next.

Contigs are contigs(tid, seq); reads are reads(tid, seq), tid being the read's own number. Lower-case letters are what a
task isn't sure of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as cg
from strandwise.functions.sequence import letters, reverse_complement
from strandwise.operators import consensus, pileup, regions, seeds
from strandwise.plans.settings import Settings


def aligned(reads: DataFrame, contigs: DataFrame, preset: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Alignments of the reads that map: rid, tid, pos, cigar, seq (of the strand and span that aligns), mapq, beg, end."""
    found = seeds.map_reads(reads, contigs, preset, keep=keep)
    turned = reads.select(F.col("tid").alias("qid"), F.upper("seq").alias("_s"))
    rows = found.join(turned, "qid").withColumn("_s", F.when(F.col("reverse"), reverse_complement(F.col("_s"))).otherwise(F.col("_s")))
    seq = F.substring(F.col("_s"), F.col("qbeg").cast("int") + 1, (F.col("qend") - F.col("qbeg")).cast("int"))
    out = rows.select(F.col("qid").alias("rid"), "tid", F.col("rbeg").alias("pos"), cg.parse(F.col("cigar")).alias("cigar"), seq.alias("seq"), "mapq")
    return pileup.spans(out)


def contig_sites(contigs: DataFrame) -> DataFrame:
    """tid, pos, ins, base, low of the contigs' letters."""
    each = contigs.filter("length(seq) > 0").select("tid", F.posexplode(letters(F.col("seq"))).alias("pos", "base"))
    return each.select("tid", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("ins"), F.upper("base").alias("base"), (F.col("base") != F.upper("base")).alias("low"))


def _strings(sites: DataFrame) -> DataFrame:
    return pileup.consensus_strings(sites).select("tid", "seq")


def score_chain(contigs: DataFrame, aln: DataFrame, s: Settings, penalty: float | None = None) -> DataFrame:
    """Task 1: the best chain of three-mers over each window, the windows stitched."""
    walked = pileup.with_padding(pileup.walk(aln), aln)
    counts = consensus.counted_kmers(consensus.with_contig(walked, contigs))
    chained = consensus.score_chain(consensus.windowed(counts, s.window, s.overlap), penalty or s.penalty_short, s.least_share, ("tid", "win"))
    sites = chained.select("tid", "win", "pos", "ins", "base", (F.col("zero") | F.col("low")).alias("low"))
    return _strings(regions.stitch(sites, s.stitch))


def haplotypes(contigs: DataFrame, aln: DataFrame, s: Settings) -> DataFrame:
    """Tasks 2 and 4: lower-case regions get the haplotype that most of the reads that span them show."""
    sites = contig_sites(contigs)
    masked = regions.position_runs(sites.filter("low").select("tid", "pos"), gap=s.region_gap).select("tid", "beg", "end")
    sure = sites.filter(~F.col("low")).select("tid", "pos")
    parts = regions.split_regions(masked, sure, longest=s.longest_region)
    best = consensus.best_haplotypes(consensus.region_haplotypes(aln.filter(F.col("mapq") >= s.min_mapq), parts), 60 * s.observations)
    # The whole haplotype stands at the region's first site, and nothing at the others.
    new = best.select("tid", "beg", F.explode(F.sequence(F.col("beg"), F.col("end") - 1)).alias("pos"), "hap")
    shown = F.when((F.col("pos") == F.col("beg")) & (F.col("hap") != ""), F.col("hap")).otherwise(pileup.GAP)
    return _strings(consensus.update_sites(sites, new.select("tid", "pos", F.lit(0).alias("ins"), shown.alias("base"), F.lit(False).alias("low"))))


def snp_phase(contigs: DataFrame, aln: DataFrame, s: Settings) -> DataFrame:
    """Task 3: sites with a better base are replaced; at heterozygous ones the phased haplotype's base is taken, in
    lower case."""
    sites = contig_sites(contigs)
    walked = pileup.walk(aln, ("rid", "tid", "mapq"))
    counts = walked.filter("ins = 0").groupBy("tid", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"))
    called = consensus.call_snps(counts, sites.select("tid", "pos", "base"), s.snp_low, s.least_snp_count)
    het = called.filter("call = 1")
    phased = consensus.phase(het, consensus.snp_links(aln, het)).select("tid", "pos", "allele")
    chosen = het.join(phased, ["tid", "pos"]).select("tid", "pos", F.when(F.col("allele") == 0, F.col("first")).otherwise(F.coalesce("second", "first")).alias("base"), F.lit(True).alias("low"))
    new = called.filter("call = 2").select("tid", "pos", F.col("first").alias("base"), F.lit(False).alias("low")).unionByName(chosen)
    return _strings(consensus.update_sites(sites, new.withColumn("ins", F.lit(0))))


def long_consensus(contigs: DataFrame, aln: DataFrame, s: Settings) -> DataFrame:
    """Tasks 5 and 6: the best path over the reads' positional three-mers; the contig is one of the paths."""
    own = consensus.contig_positional_kmers(contigs, pileup.read_insertions(aln))
    edges = consensus.windowed(pileup.counted_positional(pileup.read_positional_kmers(aln).unionByName(own)), s.window, s.overlap)
    every = pileup.depth(aln.select("tid", "pos", "cigar"), skip_deletions=False).withColumnRenamed("depth", "coverage")
    contig = own.filter("ins = 0").select("tid", "pos", F.lit(1).cast("long").alias("coverage"))
    coverage = consensus.windowed(every.unionByName(contig).groupBy("tid", "pos").agg(F.sum("coverage").alias("coverage")), s.window, s.overlap)
    found = consensus.msa_consensus(edges, coverage, s.read_type, ("tid", "win"))
    return _strings(regions.stitch(found.select("tid", "win", "pos", "ins", "base", "low"), s.stitch))


Task = Callable[[DataFrame, DataFrame, Settings], DataFrame]
TASKS: dict[int, Task] = {1: score_chain, 2: haplotypes, 3: snp_phase, 4: haplotypes, 5: long_consensus, 6: long_consensus}


def run(contigs: DataFrame, s: Settings, short: DataFrame | None = None, long: DataFrame | None = None, materialise: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Contigs after all tasks. Alignments, which a task looks at more than once, and what it gives to the next are
    written by materialise: by default to a reliable checkpoint, in the folder that spark.checkpoint.dir names."""
    keep = materialise or _checkpoint
    for k, task in enumerate(s.tasks(short is not None, long is not None)):
        reads, preset = (long, f"map-{'pb' if s.read_type == 'clr' else s.read_type}") if task in (5, 6) else (short, "sr")
        aln = keep(aligned(reads, contigs, preset, keep), f"alignments-{k}")
        polished = keep(TASKS[task](contigs, aln, s), f"polished-{k}")
        lost = contigs.join(polished.select("tid"), "tid", "left_anti").select("tid", "seq")
        contigs = keep(polished.unionByName(lost), f"contigs-{k}")
    return contigs.withColumn("seq", F.upper("seq")) if s.uppercase else contigs


def _checkpoint(df: DataFrame, _: str) -> DataFrame:
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()
