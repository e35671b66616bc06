"""Tables, filters, histograms and tests over transcripts, samples and groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceforge.functions import intervals as X
from spliceforge.functions import stats
from spliceforge.functions.filters import CATEGORY_NAMES, SUBCATEGORIES, default_filters
from spliceforge.operators import bubbles, collapse, differential, segments
from spliceforge.operators.assign import best_genes, loci, novel_genes, novel_types
from spliceforge.operators.current import current_rows
from spliceforge.operators.depth import depth_profile
from spliceforge.operators.histogram import histogram
from spliceforge.operators.intervals import overlap_join
from spliceforge.operators.novelty import classify_transcripts
from spliceforge.plans import model as M
from spliceforge.plans.genome import GENOME_SQL, transcript_tags
from spliceforge.plans.structure import FRAGMENT_SQL, MIN_TOTAL, REF
from spliceforge.session import materialize, ship_package, table

GROUPS = ("base", "heat")
#: Reads of an event that a sample must have to count as covering it, and how many samples must (the tables hold few reads an event).
MIN_COVERED, MIN_SAMPLES = 3, 3
LENGTH = X.exonic_length
COV = "coalesce(coverage, 0)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample: the latest."""
    return current_rows(table(spark, d, "sample_table"), "file_name", "sample_group", "nonchimeric_reads", "chimeric_reads", key="sample_name")


def genes(spark: SparkSession, d: str) -> DataFrame:
    """One row per gene and sample: the latest."""
    rows = table(spark, d, "gene").where("gene_id is not null and sample_name is not null").withColumn("key", F.concat_ws("|", "gene_id", "sample_name"))
    return current_rows(rows, "gene_id", "sample_name", "gene_name", "chr", "strand", "gene_begin", "gene_finish", "is_annotated", "transcripts", key="key").drop("key")


# ------------------------------------------------------------------ tables
def gene_table(spark: SparkSession, d: str) -> DataFrame:
    counts = M.in_genes(spark, d).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_transcripts"))
    g = genes(spark, d).groupBy("gene_id").agg(F.max("gene_name").alias("gene_name"), F.min("gene_begin").alias("start"), F.max("gene_finish").alias("end"), F.count(F.lit(1)).alias("n_samples"), F.max(F.coalesce("is_annotated", F.lit(False))).alias("is_annotated"))
    return g.join(counts, "gene_id", "left").withColumns({"n_transcripts": F.coalesce("n_transcripts", F.lit(0)), "gene_name": F.coalesce("gene_name", "gene_id")})


def category_label(category: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CATEGORY_NAMES]), category)


def transcript_table(spark: SparkSession, d: str, pseudocount: int = 0) -> DataFrame:
    """The export of transcripts: exon bounds as text, labels, reads and reads per million of the sample."""
    rows = M.transcripts(spark, d)
    s = samples(spark, d).select("sample_name", "nonchimeric_reads")
    text = lambda f: F.array_join(F.transform("exons", lambda x: x[f].cast("string")), ",")
    tpm = (F.expr(COV) + pseudocount) / F.nullif(F.col("nonchimeric_reads"), F.lit(0)) * 1e6
    return rows.join(s, "sample_name", "left").select(
        "transcript_id", "sample_name", "chr", "strand", "gene_id", "tr_start", "tr_end", LENGTH(F.col("exons")).alias("length"), F.size("exons").alias("num_exons"), text("start").alias("exon_starts"), text("end").alias("exon_ends"),
        category_label(F.col("category")).alias("novelty_class"), F.array_join(F.sort_array("subs"), ",").alias("novelty_subclasses"), "coverage", F.round(tpm, 4).alias("tpm"),
    )


def group_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reads of each gene by sample group, one column a group that the tests use, and in all."""
    s = samples(spark, d).select("sample_name", "sample_group")
    rows = M.in_genes(spark, d).join(s, "sample_name")
    part = lambda g: F.sum(F.when(F.col("sample_group") == g, F.expr(COV)).otherwise(0)).alias(f"{g}_reads")
    return rows.groupBy("gene_id").agg(*[part(g) for g in GROUPS], F.sum(F.expr(COV)).alias("all_reads"))


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of each sample by category, one column a category."""
    rows = M.transcripts(spark, d).select("sample_name", category_label(F.col("category")).alias("c"))
    return rows.groupBy("sample_name").pivot("c", list(CATEGORY_NAMES)).agg(F.count(F.lit(1))).na.fill(0)


def sample_overview(spark: SparkSession, d: str) -> DataFrame:
    rows = M.transcripts(spark, d).groupBy("sample_name").agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.count_distinct("gene_id").alias("n_genes"), F.sum(F.expr(COV)).alias("reads"),
        F.sum((F.coalesce("category", F.lit(0)) > 0).cast("int")).alias("n_novel"))
    return samples(spark, d).select("sample_name", "sample_group", "nonchimeric_reads", "chimeric_reads").join(rows, "sample_name", "left").na.fill(0, ["n_transcripts", "n_genes", "reads", "n_novel"])


def gene_tpm(spark: SparkSession, d: str) -> DataFrame:
    """Reads per million of each gene in each sample, with a pseudocount of 1."""
    rows = M.in_genes(spark, d).groupBy("gene_id", "sample_name").agg(F.sum(F.expr(COV)).alias("reads"))
    s = samples(spark, d).select("sample_name", "nonchimeric_reads").where("nonchimeric_reads > 0")
    return rows.join(s, "sample_name").select("gene_id", "sample_name", "reads", F.round((F.col("reads") + 1) / F.col("nonchimeric_reads") * 1e6, 4).alias("tpm"))


def subcategory_examples(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """The best-supported transcripts of each subcategory, by reads squared over the gene's reads."""
    rows = M.in_genes(spark, d).select("transcript_id", "gene_id", "coverage", "subs").where("coverage > 0")
    total = rows.groupBy("gene_id").agg(F.sum("coverage").alias("gene_reads"))
    rows = rows.join(total, "gene_id").withColumn("score", F.col("coverage") * F.col("coverage") / F.col("gene_reads"))
    each = rows.select("transcript_id", F.round("score", 6).alias("score"), F.explode(F.array_distinct("subs")).alias("subcategory"))
    w = Window.partitionBy("subcategory").orderBy(F.col("score").desc(), "transcript_id")  # a rank limit that Spark applies before the shuffle too
    return each.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def lowest_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = M.transcripts(spark, d).where("category is not null").select("category", F.explode("subs").alias("subcategory"))
    return rows.groupBy("subcategory").agg(F.min("category").alias("lowest"), F.count(F.lit(1)).alias("n"))


def region_genes(spark: SparkSession, d: str, chrom: str = "chr4", start: int = 0, end: int = 60_000_000) -> DataFrame:
    """Genes that overlap a region; the predicate reaches the scan."""
    hit = table(spark, d, "gene").where((F.col("chr") == chrom) & (F.col("gene_begin") < end) & (F.col("gene_finish") > start))
    return hit.groupBy("gene_id").agg(F.min("gene_begin").alias("start"), F.max("gene_finish").alias("end"))


def gene_selection(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of the annotated genes that at least three samples have, by a semi-join."""
    keep = genes(spark, d).where("is_annotated").groupBy("gene_id").agg(F.count_distinct("sample_name").alias("n")).where("n >= 3")
    return M.in_genes(spark, d).join(keep, "gene_id", "left_semi").select("transcript_id", "gene_id")


# ------------------------------------------------------------------ filters
def fragment_transcripts(transcripts: DataFrame) -> DataFrame:
    """transcript_id of the transcripts whose isoform is a piece of another's. ``transcripts``: those of genes, written."""
    rows = collapse.with_chain(transcripts.select("transcript_id", "gene_id", "chr", "strand", "exons", "coverage"))
    iso = materialize(collapse.isoforms(rows).withColumn("key", F.expr(M.GENE_KEY)).select("gene_id", "chr", "strand", "chain", "key", "isoform", "exons"), "isoforms")
    pieces = segments.contained(iso.select(F.col("key").alias("gene_id"), "isoform", "exons")).select("isoform")
    of = iso.join(pieces, "isoform", "left_semi").select("gene_id", "chr", "strand", "chain")
    return rows.join(of, ["gene_id", "chr", "strand", "chain"], "left_semi").select("transcript_id")


def _taggable(spark: SparkSession, d: str, derived: bool = False) -> DataFrame:
    """Transcripts of genes with the columns that default tags use; ``derived``: those made of the genome, the graph and the reference too."""
    rows = M.in_genes(spark, d, "sample_name", "gene_id", "coverage", "downstream_a_content", "category", "subs")
    if derived:
        rows = materialize(rows, "tagged-transcripts")
    total = rows.groupBy("gene_id").agg(F.sum(F.expr(COV)).alias("gene_coverage"))
    if not derived:
        return rows.join(total, "gene_id")
    pieces = fragment_transcripts(rows).withColumn("fragments", F.array(F.lit(1)))
    none = F.array().cast("array<int>")
    both = rows.join(total, "gene_id").join(transcript_tags(spark, d, rows), "transcript_id", "left").join(pieces, "transcript_id", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("noncanonical", "novel_introns")})


def filter_query(spark: SparkSession, d: str, query: str = "(NIC or NNC) and SUBSTANTIAL and not (INTERNAL_PRIMING or UNSPLICED)") -> DataFrame:
    return _taggable(spark, d).where(default_filters().query(query, "transcript")).select("transcript_id", "gene_id")


STAT_TAGS = ("INTERNAL_PRIMING", "RTTS", "NONCANONICAL_SPLICING", "NOVEL_TRANSCRIPT", "UNSPLICED", "SUBSTANTIAL", "FRAGMENT")


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts and reads by sample and tag; PASS has none of the tags, total is all."""
    f = default_filters()
    hits = F.array_compact(F.array(*[F.when(f.column(t), F.lit(t)) for t in STAT_TAGS]))
    rows = _taggable(spark, d, derived=True).withColumn("tags", hits)
    tags = F.concat(F.when(F.size("tags") == 0, F.array(F.lit("PASS"))).otherwise(F.col("tags")), F.array(F.lit("total")))
    return rows.select("sample_name", "coverage", F.explode(tags).alias("tag")).groupBy("sample_name", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(COV)).alias("reads"))


def substantial(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts with more than a hundredth of their gene's reads."""
    return _taggable(spark, d).where(default_filters().column("SUBSTANTIAL")).select("transcript_id")


def altsplice_stats(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts and reads by sample group and subcategory, unknown ones and the total included."""
    s = samples(spark, d).select("sample_name", F.coalesce("sample_group", F.lit("none")).alias("sample_group"))
    known = F.array(*[F.lit(x) for x in ("FSM", *SUBCATEGORIES)])
    subs = F.coalesce(F.array_intersect("subs", known), F.array().cast("array<string>"))
    each = F.concat(F.when(F.size(subs) == 0, F.array(F.lit("unknown"))).otherwise(subs), F.array(F.lit("total")))
    rows = M.transcripts(spark, d).join(s, "sample_name").select("sample_group", "coverage", F.explode(each).alias("subcategory"))
    return rows.groupBy("sample_group", "subcategory").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(COV)).alias("reads"))


# ------------------------------------------------------------------ histograms
def hist_length(spark: SparkSession, d: str) -> DataFrame:
    return histogram(M.transcripts(spark, d), LENGTH(F.col("exons")), -0.5, 9999.5, 50, "sample_name")


def hist_coverage(spark: SparkSession, d: str) -> DataFrame:
    return histogram(M.transcripts(spark, d), F.col("coverage"), 0.5, 1000.5, 50, "sample_name")


def hist_exons(spark: SparkSession, d: str) -> DataFrame:
    """Weighted by reads."""
    return histogram(M.transcripts(spark, d), F.size("exons"), 0.5, 68.5, 34, "sample_name", F.col("coverage"))


def hist_downstream_a(spark: SparkSession, d: str) -> DataFrame:
    return histogram(M.transcripts(spark, d), F.coalesce("a_content", F.lit(-1.0)), 0.0, 1.0, 30, "sample_name")


def hist_transcripts_per_gene(spark: SparkSession, d: str) -> DataFrame:
    per = M.in_genes(spark, d).where("coverage >= 2").groupBy("sample_name", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    return histogram(per, F.col("n"), 0.5, 49.5, 49, "sample_name")


def length_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean reads by length bin of 500 bases; a bin holds its upper bound."""
    rows = M.transcripts(spark, d).select(F.ceil(LENGTH(F.col("exons")) / 500).alias("bin_no"), "coverage").where("coverage is not null")
    return rows.groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage"), 4).alias("mean_reads"))


# ------------------------------------------------------------------ intervals and genes
def exon_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = M.transcripts(spark, d).select("chr", "coverage", F.inline("exons"))
    return depth_profile(rows, ["chr"], "start", "end", "coverage")


def junction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads over each intron of each sample, as a short-read junction table has them."""
    rows = M.transcripts(spark, d).select("sample_name", "chr", "coverage", F.inline(X.introns(F.col("exons"))))
    return rows.groupBy("sample_name", "chr", "donor", "acceptor").agg(F.sum(F.expr(COV)).alias("n"))


def gene_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Genes of both strands that each transcript's span overlaps."""
    t = M.transcripts(spark, d).select("transcript_id", "chr", "tr_start", "tr_end")
    g = genes(spark, d).groupBy("gene_id", "chr").agg(F.min("gene_begin").alias("g_start"), F.max("gene_finish").alias("g_end")).where("chr is not null").withColumnRenamed("gene_id", "other_gene")
    return overlap_join(t, g, ["chr"], ("tr_start", "tr_end"), ("g_start", "g_end"), 100_000).select("transcript_id", "other_gene")


def best_gene(spark: SparkSession, d: str) -> DataFrame:
    """The gene that each transcript which is no full splice match fits best. Genes with a full splice match are known by those, all others are
    novel and known by what their first sample has."""
    rows = M.transcripts(spark, d, "sample_name", "gene_id", "category").select("transcript_id", "sample_name", "gene_id", "chr", "strand", "exons", "category")
    rows = materialize(rows, "placed")
    known = rows.where(REF).where("gene_id is not null")
    rest = rows.where("gene_id is not null").join(known.select("gene_id").distinct(), "gene_id", "left_anti")
    first = rest.groupBy("gene_id").agg(F.min("sample_name").alias("sample_name"))
    novel = rest.join(first, ["gene_id", "sample_name"])
    genes = known.withColumn("is_annotated", F.lit(True)).unionByName(novel.select(known.columns).withColumn("is_annotated", F.lit(False)))
    return best_genes(rows.where("category is null or category != 0"), genes)


def novel_type(spark: SparkSession, d: str) -> DataFrame:
    rows = M.transcripts(spark, d).select("transcript_id", "gene_id", "chr", "strand", "exons", "category")
    return novel_types(rows.where("gene_id is null"), rows.where(f"gene_id is not null and {REF}"))


def novel_gene(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(M.transcripts(spark, d).where("gene_id is null").select("transcript_id", "chr", "strand", "exons"), "no-gene")
    return novel_genes(rows)


def gene_loci(spark: SparkSession, d: str) -> DataFrame:
    """Genes chained into loci of a chromosome and strand where gaps are at most 300 kb."""
    g = genes(spark, d).where("chr is not null and strand is not null").groupBy("gene_id", "chr", "strand").agg(F.min("gene_begin").alias("start"), F.max("gene_finish").alias("end"))
    rows = loci(g, ["chr", "strand"], "start", "end")
    return rows.groupBy("chr", "strand", "locus_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_genes"))


def novelty_class(spark: SparkSession, d: str) -> DataFrame:
    """Category and subcategories of each transcript of a gene against the gene's full-splice-match chains on one strand."""
    rows = materialize(M.in_genes(spark, d).withColumn("gene_id", F.expr(M.GENE_KEY)).select("transcript_id", "gene_id", "chr", "strand", "exons", "category"), "novelty-input")
    return classify_transcripts(rows, rows.where(REF))


# ------------------------------------------------------------------ tests
def _two_groups(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Simple events (``every``: those of all types, keyed with via) with alternative reads (x) and all reads (n) of two groups of samples."""
    iso, reads = M.isoforms_and_reads(spark, d)
    segs, path, strand = M.graph(iso)
    s = samples(spark, d).where(F.col("sample_group").isin(*GROUPS)).select("sample_name", "sample_group")
    reads = reads.join(s, "sample_name").groupBy("gene_id", "isoform", "sample_group").agg(F.sum("reads").alias("reads"))
    t = M.all_totals(path, strand, reads, ("sample_group",)) if every else bubbles.simple_event_totals(path, strand, reads, ("sample_group",))
    pick = lambda g, v: F.sum(F.when(F.col("sample_group") == g, v).otherwise(0))
    both = F.col("primary_reads") + F.col("alternative_reads")
    cols = [pick(g, v).alias(f"{n}{i}") for i, g in enumerate(GROUPS) for n, v in (("x", F.col("alternative_reads")), ("n", both))]
    rows = t.groupBy(*_key(every)).agg(*cols)
    x, n = F.col("x0") + F.col("x1"), F.col("n0") + F.col("n1")
    # written once: each test below uses its columns several times
    return materialize(rows.where((F.col("n0") > 0) & (F.col("n1") > 0) & (n >= MIN_TOTAL) & (x >= n * F.lit(0.1)) & (x <= n * F.lit(0.9))), "group-events")


def _key(every: bool) -> list[str]:
    return bubbles.KEY if every else bubbles.EVENT


def _loglik(x: Column, n: Column) -> Column:
    p = x / n
    return F.when(x > 0, x * F.ln(p)).otherwise(0.0) + F.when(n > x, (n - x) * F.ln(1 - p)).otherwise(0.0)


def _lr(x0: Column, n0: Column, x1: Column, n1: Column) -> Column:
    return F.greatest(2 * (_loglik(x0, n0) + _loglik(x1, n1) - _loglik(x0 + x1, n0 + n1)), F.lit(0.0))


def proportion_z(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Pooled z statistic of the alternative share between two groups."""
    p = (F.col("x0") + F.col("x1")) / (F.col("n0") + F.col("n1"))
    z = (F.col("x0") / F.col("n0") - F.col("x1") / F.col("n1")) / F.sqrt(p * (1 - p) * (1 / F.col("n0") + 1 / F.col("n1")))
    return _two_groups(spark, d, every).select(*_key(every), "x0", "n0", "x1", "n1", F.round(z, 5).alias("z"))


def binomial_lr(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Likelihood ratio statistic of separate against pooled binomials."""
    rows = _two_groups(spark, d, every)
    return rows.select(*_key(every), F.round(_lr(*[F.col(c) for c in ("x0", "n0", "x1", "n1")]), 4).alias("statistic"))


def adjusted_p(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The same statistic read as chi square of two degrees, whose p is exp(-x/2), adjusted for the false discovery rate."""
    rows = _two_groups(spark, d, every).select(*_key(every), F.exp(-F.round(_lr(*[F.col(c) for c in ("x0", "n0", "x1", "n1")]), 4) / 2).alias("p"))
    return stats.adjust_fdr(rows, "p").select(*_key(every), F.round("p", 6).alias("p_value"), F.round("padj", 6).alias("padj"))


def all_proportion_z(spark: SparkSession, d: str) -> DataFrame:
    return proportion_z(spark, d, every=True)


def all_binomial_lr(spark: SparkSession, d: str) -> DataFrame:
    return binomial_lr(spark, d, every=True)


def all_adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    return adjusted_p(spark, d, every=True)


def test_groups(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """The samples of the two groups that the queries compare; the driver reads a row a sample."""
    rows = samples(spark, d).where(F.col("sample_group").isin(*GROUPS)).select("sample_group", "sample_name").collect()
    return {g: sorted(r["sample_name"] for r in rows if r["sample_group"] == g) for g in GROUPS}


def sample_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the events of all types in each sample."""
    iso, reads = M.isoforms_and_reads(spark, d)
    _, path, strand = M.graph(iso)
    return M.all_totals(path, strand, reads, ("sample_name",))


def altsplice_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The events that :func:`altsplice_test` tests, with the samples of both groups that cover them."""
    groups = test_groups(spark, d)
    rows = differential.tested_events(differential.event_cells(sample_totals(spark, d), groups), sum(map(len, groups.values())), MIN_TOTAL, min_n=MIN_COVERED, min_sa=MIN_SAMPLES)
    return rows.select(*bubbles.KEY, "x", "n", "n_covered")


def altsplice_test(spark: SparkSession, d: str) -> DataFrame:
    """Differential splicing: beta-binomial likelihood ratio of two groups of samples per event of any type, with shares, dispersions and padj."""
    return differential.splicing_test(sample_totals(spark, d), test_groups(spark, d), min_total=MIN_TOTAL, min_n=MIN_COVERED, min_sa=MIN_SAMPLES)


def isoform_test(spark: SparkSession, d: str) -> DataFrame:
    """:func:`isoform_usage` with p (chi square of one degree less than isoforms) and padj."""
    ship_package(spark)
    rows = isoform_usage(spark, d)
    return stats.adjust_fdr(rows.withColumn("p", differential.p_of_chi2(F.col("chi2"), F.col("n_isoforms") - 1)), "p")


def isoform_usage(spark: SparkSession, d: str, top: int = 10, min_cov: int = 25) -> DataFrame:
    """Isoform by group table of each gene with the ``top`` isoforms, the rest folded into the last: chi square and the greatest change of share."""
    s = samples(spark, d).where(F.col("sample_group").isin(*GROUPS)).select("sample_name", "sample_group")
    reads = M.isoforms_and_reads(spark, d)[1].join(s, "sample_name").groupBy("gene_id", "isoform").agg(*[F.sum(F.when(F.col("sample_group") == g, F.col("reads")).otherwise(0)).alias(f"r{i}") for i, g in enumerate(GROUPS)])
    w = Window.partitionBy("gene_id").orderBy((F.col("r0") + F.col("r1")).desc(), "isoform")
    cells = reads.where("r0 + r1 > 0").withColumn("k", F.least(F.row_number().over(w), F.lit(top))).groupBy("gene_id", "k").agg(F.sum("r0").alias("r0"), F.sum("r1").alias("r1"))
    total = cells.groupBy("gene_id").agg(F.sum("r0").alias("t0"), F.sum("r1").alias("t1"), F.count(F.lit(1)).alias("n_isoforms")).where((F.col("t0") >= min_cov) & (F.col("t1") >= min_cov) & (F.col("n_isoforms") > 1))
    both = cells.join(total, "gene_id")
    expected = lambda i: (F.col("r0") + F.col("r1")) * F.col(f"t{i}") / (F.col("t0") + F.col("t1"))
    off = lambda i: F.when(F.col("n_isoforms") == 2, F.abs(F.col(f"r{i}") - expected(i)) - F.least(F.lit(0.5), F.abs(F.col(f"r{i}") - expected(i)))).otherwise(F.abs(F.col(f"r{i}") - expected(i)))
    change = F.col("r1") / F.col("t1") - F.col("r0") / F.col("t0")
    agg = both.withColumns({"part": F.pow(off(0), 2) / expected(0) + F.pow(off(1), 2) / expected(1), "change": change}).groupBy("gene_id").agg(
        F.round(F.sum("part"), 4).alias("chi2"), F.max("n_isoforms").alias("n_isoforms"), F.slice(F.sort_array(F.collect_list("change"), asc=False), 1, 2).alias("up"), F.slice(F.sort_array(F.collect_list("change")), 1, 2).alias("down"))
    add = lambda c, keep: F.aggregate(c, F.lit(0.0), lambda a, x: a + keep(x))
    up, down = add("up", lambda x: F.greatest(x, F.lit(0.0))), add("down", lambda x: F.least(x, F.lit(0.0)))
    return agg.select("gene_id", "n_isoforms", "chi2", F.round(F.when(up >= -down, up).otherwise(down), 5).alias("delta_share"))


def coordination_table(spark: SparkSession, d: str, min_dist: int = 1, exclusive: bool = False, min_alt_fraction: float = 0.1) -> DataFrame:
    """Joint support of two events of a gene: reads of isoforms on either side of both, log2 odds ratio and changes of conditional share.

    Only events frequent by themselves are paired, with those behind them; the four cells come from isoforms that have a side in both.
    ``exclusive``: ME events beside the simple ones, a_via and b_via telling those of one A and B apart.
    """
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    reads = iso.select("gene_id", "isoform", "reads")
    sides = M.all_events(path, strand) if exclusive else bubbles.simple_events(path, strand).withColumn("via", F.lit(None).cast("int"))
    sides = materialize(sides.withColumn("via", F.coalesce("via", F.lit(-1))), "event-sides")  # no null in the join's key
    keep = bubbles.with_coordinates(bubbles.frequent(bubbles.event_totals(sides, reads), MIN_TOTAL, 0.1), segs).select(*bubbles.KEY, "start", "end")
    named = sides.join(keep, bubbles.KEY).join(reads.where("reads > 0"), ["gene_id", "isoform"])
    key = F.struct("start", "end", "event_type", "node_a", "node_b", "via")
    named = materialize(named.select("gene_id", "isoform", key.alias("ev"), (F.col("side") == "alternative").cast("int").alias("alt"), "reads"), "event-support")
    one = named.select("gene_id", "isoform", F.col("ev").alias("a"), F.col("alt").alias("alt_a"), "reads")
    two = named.select("gene_id", "isoform", F.col("ev").alias("b"), F.col("alt").alias("alt_b"))
    pairs = one.join(two, ["gene_id", "isoform"]).where((F.col("b")["start"] - F.col("a")["end"]) >= min_dist)
    cell = lambda x, y: F.sum(F.when((F.col("alt_a") == x) & (F.col("alt_b") == y), F.col("reads")).otherwise(0))
    t = pairs.groupBy("gene_id", "a", "b").agg(cell(0, 0).alias("pri_pri"), cell(0, 1).alias("pri_alt"), cell(1, 0).alias("alt_pri"), cell(1, 1).alias("alt_alt"))
    pp, pa, ap, aa = (F.col(c) for c in ("pri_pri", "pri_alt", "alt_pri", "alt_alt"))
    total = pp + pa + ap + aa
    t = t.where((total >= MIN_TOTAL) & (F.least(pp + pa, ap + aa, pp + ap, pa + aa) >= total * F.lit(min_alt_fraction)))
    via = [F.nullif(F.col(f"{x}.via"), F.lit(-1)).alias(f"{x}_via") for x in ("a", "b")] if exclusive else []
    return t.select("gene_id", *via, F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("a.event_type").alias("a_type"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), F.col("b.event_type").alias("b_type"),
                    "pri_pri", "pri_alt", "alt_pri", "alt_alt", F.round(stats.log2_odds_ratio(pp, pa, ap, aa), 4).alias("log2_or"), F.round(aa / (ap + aa) - (pa + aa) / total, 5).alias("dcpsi_ab"), F.round(aa / (pa + aa) - (ap + aa) / total, 5).alias("dcpsi_ba"))


def all_coordination_table(spark: SparkSession, d: str) -> DataFrame:
    """:func:`coordination_table` with ME events."""
    return coordination_table(spark, d, exclusive=True)


def coordination_test(spark: SparkSession, d: str, test: str = "fisher") -> DataFrame:
    """Test of the coordination tables, ME events included, adjusted: Fisher's exact one, or ``chi2``."""
    ship_package(spark)
    if test not in ("fisher", "chi2"):
        raise ValueError("test must be fisher or chi2")

    @F.pandas_udf("statistic double, p double")
    def tested(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.DataFrame:
        run = stats.fisher_exact if test == "fisher" else lambda *x: stats.chi2_table([x[:2], x[2:]])
        return pd.DataFrame([run(*map(int, x)) for x in zip(a, b, c, e)], columns=["statistic", "p"], dtype=float)

    rows = all_coordination_table(spark, d).withColumn("t", tested("pri_pri", "pri_alt", "alt_pri", "alt_alt"))
    return stats.adjust_fdr(rows.select("*", "t.*").drop("t"), "p")


def coordination_chi2(spark: SparkSession, d: str) -> DataFrame:
    return coordination_test(spark, d, "chi2")


def rarefaction(spark: SparkSession, d: str, parts: int = 20, min_cov: int = 2) -> DataFrame:
    """Expected transcripts with at least two reads if a share of a sample's reads is drawn; transcripts of equal reads are counted once."""
    counts = M.transcripts(spark, d).where("coverage > 0").groupBy("sample_name", "coverage").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    f, k = F.col("part") / parts, F.col("coverage")
    seen = 1 - F.pow(1 - f, k) - k * f * F.pow(1 - f, k - 1)
    return rows.groupBy("sample_name", "part").agg(F.round(F.sum(F.col("n") * seen), 4).alias("expected"))


def saturation(spark: SparkSession, d: str) -> DataFrame:
    """Abundance that each sample's reads show twice with a chance of 0.8, in reads per million."""
    ship_package(spark)

    @F.pandas_udf("double")
    def threshold(n: pd.Series) -> pd.Series:
        return n.map(lambda k: stats.tpm_threshold(int(k)) if k == k and k > 10 else None).astype(float)

    return samples(spark, d).select("sample_name", "nonchimeric_reads", threshold("nonchimeric_reads").alias("tpm_threshold"))


def event_embedding(spark: SparkSession, d: str, top: int = 500, prior: int = 2) -> DataFrame:
    """Samples in the plane of the two greatest principal components of smoothed shares of the ``top`` events of any type by variance.

    The matrix that the driver decomposes has a row a sample and at most ``top`` columns.
    """
    iso, reads = M.isoforms_and_reads(spark, d)
    segs, path, strand = M.graph(iso)
    t = M.all_totals(path, strand, reads, ("sample_name",))
    rows = materialize(t.select(F.concat_ws("/", *bubbles.KEY).alias("event"), "sample_name", F.col("alternative_reads").alias("k"), (F.col("primary_reads") + F.col("alternative_reads")).alias("n")), "embedding-cells")
    mean = rows.groupBy("event").agg((F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("n").alias("total")).where(F.col("total") >= MIN_TOTAL)
    psi = rows.join(mean, "event").withColumn("psi", (F.col("k") + F.col("mean") * prior) / (F.col("n") + prior))
    best = psi.groupBy("event", "mean").agg(F.var_pop("psi").alias("v")).orderBy(F.col("v").desc(), "event").limit(top)
    cells = psi.join(best.select("event"), "event").select("event", "sample_name", "psi", "mean").toPandas()
    if cells.empty:
        return spark.createDataFrame([], "sample_name string, pc1 double, pc2 double")
    wide = cells.pivot(index="sample_name", columns="event", values="psi").sort_index()
    wide = wide.fillna(cells.groupby("event")["mean"].first())
    m = wide.to_numpy() - wide.to_numpy().mean(0)
    u, sv, _ = np.linalg.svd(m, full_matrices=False)
    pc = (u * sv)[:, :2]
    if pc.shape[1] < 2:
        pc = np.hstack([pc, np.zeros((len(pc), 2 - pc.shape[1]))])
    pc *= np.where(pc[np.abs(pc).argmax(0), [0, 1]] < 0, -1, 1)
    return spark.createDataFrame([(s, float(a), float(b)) for s, (a, b) in zip(wide.index, pc)], "sample_name string, pc1 double, pc2 double")


QUERIES = {f.__name__: f for f in (
    gene_table, transcript_table, group_coverage, category_pivot, sample_overview, gene_tpm, subcategory_examples, lowest_categories, region_genes, gene_selection,
    filter_query, filter_stats, substantial, altsplice_stats, hist_length, hist_coverage, hist_exons, hist_downstream_a, hist_transcripts_per_gene, length_bins,
    exon_depth, junction_counts, gene_overlaps, best_gene, novel_type, novel_gene, gene_loci, novelty_class,
    proportion_z, binomial_lr, adjusted_p, all_proportion_z, all_binomial_lr, all_adjusted_p, altsplice_candidates, altsplice_test, isoform_usage, isoform_test, coordination_table, all_coordination_table, coordination_test, coordination_chi2, rarefaction, saturation, event_embedding,
)}

_W = f"with {M.BASE}"
_SM = """sm as (select * from sample_table where sample_name is not null qualify row_number() over (partition by sample_name order by loaded_at desc nulls last) = 1)"""
_GN = """gn as (select * from gene where gene_id is not null and sample_name is not null qualify row_number() over (partition by gene_id, sample_name order by loaded_at desc nulls last) = 1)"""
_TG = f"tg as (select *, sum({COV}) over (partition by gene_id) as gene_coverage from tr where gene_id is not null)"
_NN = "sum(coalesce(coverage, 0))"


def _hist(value: str, low: float, high: float, n: int, source: str = "tr", weight: str = "1") -> str:
    return f"""{_W}, hv as (select sample_name, cast({value} as double) as v, {weight} as w from {source}),
      hb as (select sample_name, cast(least(floor((v - {low}) / cast({(high - low) / n!r} as double)), {n - 1}) as int) as bin_no, sum(w) as c from hv where v >= {low} and v <= {high} group by all),
      hs as (select sample_name, cast(k as int) as bin_no from (select distinct sample_name from hv), (select unnest(range(0, {n})) as k))
      select sample_name, bin_no, cast(coalesce(c, 0) as bigint) as count from hs left join hb using (sample_name, bin_no)"""


_PG = """(select sample_name, gene_id, count(*) as n from tr where gene_id is not null and coverage >= 2 group by all)"""
_KNOWN = ", ".join("'" + s.replace("'", "''") + "'" for s in ("FSM", *SUBCATEGORIES))
_GRAPH = f"{_W}, {M.sql_iso()}, {M.sql_graph()}, {M.SIMPLE_SQL.format(p='')}"
_GR = f"""{_SM}, sr as (select i.isoform, i.gene, sample_group, sum(coalesce(c.coverage, 0)) as reads from ch c join iso i using (gene_id, chr, strand, chain) join sm using (sample_name) where sample_group in ('{GROUPS[0]}', '{GROUPS[1]}') group by all)"""
_TWO = f"""{_GRAPH}, {_GR}, tw0 as (select e.gene, event_type, e.a, e.b, sum(case when sample_group = '{GROUPS[0]}' and side = 'alternative' then reads else 0 end) as x0, sum(case when sample_group = '{GROUPS[0]}' then reads else 0 end) as n0,
    sum(case when sample_group = '{GROUPS[1]}' and side = 'alternative' then reads else 0 end) as x1, sum(case when sample_group = '{GROUPS[1]}' then reads else 0 end) as n1 from sim e join sr using (isoform) group by all),
  tw as (select gene as gene_id, event_type, a as node_a, b as node_b, cast(x0 as bigint) as x0, cast(n0 as bigint) as n0, cast(x1 as bigint) as x1, cast(n1 as bigint) as n1 from tw0
    where n0 > 0 and n1 > 0 and n0 + n1 >= {MIN_TOTAL} and x0 + x1 >= (n0 + n1) * cast(0.1 as double) and x0 + x1 <= (n0 + n1) * cast(0.9 as double))"""
_ALL_TWO = f"""{_GRAPH}, {M.ME_SQL.format(p='')}, {M.ALL_SQL}, {_GR}, tw0 as (select e.gene, event_type, e.a, e.b, via, sum(case when sample_group = '{GROUPS[0]}' and side = 'alternative' then reads else 0 end) as x0, sum(case when sample_group = '{GROUPS[0]}' then reads else 0 end) as n0,
    sum(case when sample_group = '{GROUPS[1]}' and side = 'alternative' then reads else 0 end) as x1, sum(case when sample_group = '{GROUPS[1]}' then reads else 0 end) as n1 from evs e join sr using (isoform) group by all),
  tw as (select gene as gene_id, event_type, a as node_a, b as node_b, via, cast(x0 as bigint) as x0, cast(n0 as bigint) as n0, cast(x1 as bigint) as x1, cast(n1 as bigint) as n1 from tw0
    where n0 > 0 and n1 > 0 and n0 + n1 >= {MIN_TOTAL} and x0 + x1 >= (n0 + n1) * cast(0.1 as double) and x0 + x1 <= (n0 + n1) * cast(0.9 as double))"""
_LL = "(case when {x} > 0 then {x} * ln(({x}) / ({n})) else 0.0 end + case when {n} > {x} then ({n} - ({x})) * ln(1 - ({x}) / ({n})) else 0.0 end)"
_LR = f"greatest(2 * ({_LL.format(x='x0', n='n0')} + {_LL.format(x='x1', n='n1')} - {_LL.format(x='(x0 + x1)', n='(n0 + n1)')}), 0.0)"

SQL = {
    "gene_table": f"""{_W}, {_GN}, k as (select gene_id, count(*) as n from tr where gene_id is not null group by 1)
        select g.gene_id, coalesce(max(gene_name), g.gene_id) as gene_name, min(gene_begin) as start, max(gene_finish) as "end", count(*) as n_samples, bool_or(coalesce(is_annotated, false)) as is_annotated, coalesce(max(n), 0) as n_transcripts from gn g left join k using (gene_id) group by g.gene_id""",
    "transcript_table": f"""{_W}, {_SM}, xs as (select transcript_id, string_agg(s, ',' order by exon_no) as exon_starts, string_agg(e, ',' order by exon_no) as exon_ends from exons group by 1)
        select transcript_id, sample_name, chr, strand, gene_id, tr_start, tr_end, len as length, cast(n_exons as int) as num_exons, exon_starts, exon_ends, ['FSM','ISM','NIC','NNC','NOVEL'][category + 1] as novelty_class,
        array_to_string(list_sort(subs), ',') as novelty_subclasses, coverage, round({COV} / nullif(nonchimeric_reads, 0) * 1e6, 4) as tpm from tr join xs using (transcript_id) left join sm using (sample_name)""",
    "group_coverage": f"""{_W}, {_SM} select gene_id, {', '.join(f"cast(sum(case when sample_group = '{g}' then {COV} else 0 end) as bigint) as {g}_reads" for g in GROUPS)}, cast({_NN} as bigint) as all_reads from tr join sm using (sample_name) where gene_id is not null group by 1""",
    "category_pivot": f"""{_W} select sample_name, {', '.join(f'count(*) filter (where category = {i}) as "{c}"' for i, c in enumerate(CATEGORY_NAMES))} from tr group by 1""",
    "sample_overview": f"""{_W}, {_SM} select sample_name, any_value(sample_group) as sample_group, any_value(nonchimeric_reads) as nonchimeric_reads, any_value(chimeric_reads) as chimeric_reads, count(transcript_id) as n_transcripts, count(distinct gene_id) as n_genes,
        cast({_NN} as bigint) as reads, cast(coalesce(sum(cast(coalesce(category, 0) > 0 as int)), 0) as bigint) as n_novel from sm left join tr using (sample_name) group by 1""",
    "gene_tpm": f"""{_W}, {_SM}, r as (select gene_id, sample_name, cast({_NN} as bigint) as reads from tr where gene_id is not null group by all) select gene_id, sample_name, reads, round((reads + 1) / nonchimeric_reads * 1e6, 4) as tpm from r join sm using (sample_name) where nonchimeric_reads > 0""",
    "subcategory_examples": f"""{_W}, p as (select transcript_id, coverage, subs, sum(coverage) over (partition by gene_id) as g from tr where gene_id is not null and coverage > 0),
        e as (select transcript_id, round(coverage * coverage / g, 6) as score, unnest(list_distinct(subs)) as subcategory from p)
        select *, cast(row_number() over (partition by subcategory order by score desc, transcript_id) as int) as rank_no from e qualify rank_no <= 3""",
    "lowest_categories": f"{_W} select subcategory, min(category) as lowest, count(*) as n from (select category, unnest(subs) as subcategory from tr where category is not null) group by 1",
    "region_genes": """select gene_id, min(gene_begin) as start, max(gene_finish) as "end" from gene where chr = 'chr4' and gene_begin < 60000000 and gene_finish > 0 group by 1""",
    "gene_selection": f"{_W}, {_GN} select transcript_id, gene_id from tr where gene_id in (select gene_id from gn where is_annotated group by 1 having count(distinct sample_name) >= 3)",
    "filter_query": f"{_W}, {_TG} select transcript_id, gene_id from tg where category in (2, 3) and coverage > 0.01 * gene_coverage and n_exons > 1",
    "filter_stats": f"""{_W}, {M.sql_iso()}, {M.sql_graph()}, {FRAGMENT_SQL}, {GENOME_SQL}, {_TG},
        st as (select gene_id, strand, category, t.transcript_id, cast(x.exon_no - 1 as int) as no, x.e as d, nxt as a from tr t join ex3 x using (transcript_id) where nxt is not null and gene_id is not null),
        nov as (select transcript_id, no from st where not exists (select 1 from st r where r.{REF} and r.gene_id = st.gene_id and r.strand = st.strand and r.d = st.d)
          and not exists (select 1 from st r where r.{REF} and r.gene_id = st.gene_id and r.strand = st.strand and r.a = st.a)),
        rt as (select distinct transcript_id from nov join mot using (transcript_id, no) where motif <> 'GTAG'),
        fr as (select transcript_id from ch join iso i using (gene_id, chr, strand, chain) where i.isoform in (select isoform from pr)),
        f as (select sample_name, coverage, list_filter([case when n_exons = 1 and a_content > 0.5 then 'INTERNAL_PRIMING' end, case when transcript_id in (select transcript_id from rt) then 'RTTS' end,
          case when transcript_id in (select transcript_id from nonc) then 'NONCANONICAL_SPLICING' end, case when category > 0 then 'NOVEL_TRANSCRIPT' end, case when n_exons = 1 then 'UNSPLICED' end,
          case when coverage > cast(0.01 as double) * gene_coverage then 'SUBSTANTIAL' end, case when transcript_id in (select transcript_id from fr) and list_has_any(subs, ['novel exonic TSS', 'novel exonic PAS', '5'' fragment', '3'' fragment']) then 'FRAGMENT' end], lambda x: x is not null) as t from tg)
        select sample_name, tag, count(*) as n, cast({_NN} as bigint) as reads from (select sample_name, coverage, unnest(list_concat(case when len(t) = 0 then ['PASS'] else t end, ['total'])) as tag from f) group by all""",
    "substantial": f"{_W}, {_TG} select transcript_id from tg where coverage > cast(0.01 as double) * gene_coverage",
    "altsplice_stats": f"""{_W}, {_SM}, k as (select coalesce(sample_group, 'none') as sample_group, coverage, list_distinct(list_filter(coalesce(subs, []), lambda x: x in ({_KNOWN}))) as t from tr join sm using (sample_name))
        select sample_group, subcategory, count(*) as n, cast({_NN} as bigint) as reads from (select sample_group, coverage, unnest(list_concat(case when len(t) = 0 then ['unknown'] else t end, ['total'])) as subcategory from k) group by all""",
    "hist_length": _hist("len", -0.5, 9999.5, 50), "hist_coverage": _hist("coverage", 0.5, 1000.5, 50), "hist_exons": _hist("n_exons", 0.5, 68.5, 34, weight="coalesce(coverage, 0)"),
    "hist_downstream_a": _hist("coalesce(a_content, -1)", 0.0, 1.0, 30), "hist_transcripts_per_gene": _hist("n", 0.5, 49.5, 49, source=_PG),
    "length_bins": f"{_W} select cast(ceil(len / 500) as bigint) as bin_no, count(*) as n, round(avg(coverage), 4) as mean_reads from tr where coverage is not null group by 1",
    "exon_depth": f"""{_W}, ch as (select chr, pos, sum(d) as d from (select chr, s as pos, {COV} as d from exons join tr using (transcript_id) union all select chr, e, -{COV} from exons join tr using (transcript_id)) group by all)
        select chr, pos as pos_from, nxt as pos_to, cast(depth as bigint) as depth from (select chr, pos, lead(pos) over w as nxt, sum(d) over w as depth from ch window w as (partition by chr order by pos)) where depth > 0 and nxt is not null""",
    "junction_counts": f"{_W} select sample_name, chr, e as donor, nxt as acceptor, cast({_NN} as bigint) as n from ex3 join tr using (transcript_id) where nxt is not null group by all",
    "gene_overlaps": f"""{_W}, {_GN}, g as (select gene_id, chr, min(gene_begin) as a, max(gene_finish) as b from gn where chr is not null group by all) select transcript_id, g.gene_id as other_gene from tr join g on g.chr = tr.chr and tr_start < b and a < tr_end""",
    "best_gene": f"""{_W}, t as (select * from tr where category is null or category <> 0), k as (select *, true as ann from tr where gene_id is not null and {REF}),
        o as (select * from tr where gene_id is not null and gene_id not in (select gene_id from k)), nv as (select *, false as ann from o qualify sample_name = min(sample_name) over (partition by gene_id)),
        r as (select * from k union all select * from nv), an as (select gene_id, bool_or(ann) as ann from r group by 1),
        rx as (select r.gene_id, chr, strand, r.transcript_id as ch, n_exons as gn, len as gl, s, e, nxt from r join ex3 using (transcript_id)), tx as (select t.transcript_id, chr, strand, n_exons as tn, len, s, e, nxt from t join ex3 using (transcript_id)),
        re as (select distinct gene_id, chr, strand, s, e from rx), ru0 as (select *, case when s <= max(e) over (partition by gene_id, chr, strand order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from re),
        ru1 as (select *, sum(f) over (partition by gene_id, chr, strand order by s, e rows unbounded preceding) as no from ru0), ru as (select gene_id, chr, strand, min(s) as a, max(e) as b from ru1 group by gene_id, chr, strand, no),
        bs as (select transcript_id, ru.gene_id, any_value(len) as len, any_value(tn) as tn, sum(least(e, b) - greatest(s, a)) as n_bases from tx join ru on ru.chr = tx.chr and ru.strand = tx.strand and s < b and a < e group by all),
        bc as (select tx.transcript_id, rx.gene_id, ch, sum(least(tx.e, rx.e) - greatest(tx.s, rx.s)) as sh, any_value(gl) as gl, any_value(len) as len, bool_or(tn = 1 and gn = 1) as one from tx join rx on rx.chr = tx.chr and rx.strand = tx.strand and tx.s < rx.e and rx.s < tx.e group by all),
        pc as (select transcript_id, gene_id, max(sh / least(len, gl)) as part, max(case when one then sh else 0 end) as single from bc group by all),
        ts as (select distinct transcript_id, chr, strand, 'd' as side, e as pos from tx where nxt is not null union select transcript_id, chr, strand, 'a', nxt from tx where nxt is not null),
        cs as (select distinct gene_id, ch, gn, chr, strand, 'd' as side, e as pos from rx where nxt is not null union select gene_id, ch, gn, chr, strand, 'a', nxt from rx where nxt is not null),
        st as (select transcript_id, gene_id, count(*) as n_sites from ts join (select distinct gene_id, chr, strand, side, pos from cs) using (chr, strand, side, pos) group by all),
        ra as (select transcript_id, gene_id, max(n / gn) as ratio from (select transcript_id, gene_id, ch, gn, count(*) as n from ts join cs using (chr, strand, side, pos) group by all) group by all),
        al as (select bs.*, part, single, coalesce(n_sites, 0) as n_sites, coalesce(ratio, 0) as ratio, ann, case when tn > 1 then n_bases else single end as w from bs join pc using (transcript_id, gene_id) left join st using (transcript_id, gene_id) left join ra using (transcript_id, gene_id) join an using (gene_id)),
        sc as (select *, case when ann and n_sites > 0 then 1 when n_sites > 0 then 2 when ann and w >= len * cast(0.25 as double) then 3 when ann and part >= 0.25 then 4 when not ann and n_bases >= len * cast(0.25 as double) then 5 end as step from al)
        select transcript_id, gene_id, cast(step as int) as step, n_sites, cast(n_bases as bigint) as n_bases from sc where step is not null
        qualify row_number() over (partition by transcript_id order by step, case when step <= 2 then n_sites when step = 3 then w when step = 4 then part else n_bases end desc, case when step <= 2 then ratio end desc, n_bases desc, gene_id) = 1""",
    "novel_gene": f"""with recursive {M.BASE}, t as (select * from tr where gene_id is null), x as (select t.transcript_id, chr, strand, len, s, e, nxt from t join ex3 using (transcript_id)),
        si as (select transcript_id, chr, strand, 'd' as side, e as pos from x where nxt is not null union all select transcript_id, chr, strand, 'a', nxt from x where nxt is not null),
        ol as (select a.transcript_id as a, b.transcript_id as b, sum(least(a.e, b.e) - greatest(a.s, b.s)) as n, any_value(a.len + b.len) as u from x a join x b on a.chr = b.chr and a.strand = b.strand and a.transcript_id <> b.transcript_id and a.s < b.e and b.s < a.e group by all),
        lk as (select distinct a.transcript_id as a, b.transcript_id as b from si a join si b on a.chr = b.chr and a.strand = b.strand and a.side = b.side and a.pos = b.pos and a.transcript_id <> b.transcript_id union select a, b from ol where n > (u - n) * cast(0.5 as double)),
        cc(node, label) using key (node) as (select transcript_id, transcript_id from t union select l.b, min(c.label) from cc c join lk l on l.a = c.node join recurring.cc r on r.node = l.b where c.label < r.label group by l.b),
        g as (select label, row_number() over (order by min(chr), min(strand), min(tr_start), label) as no from cc join t on t.transcript_id = node group by label)
        select node as transcript_id, 'PB_novel_' || lpad(cast(no as varchar), 5, '0') as novel_gene from cc join g using (label)""",
    "novel_type": f"""{_W}, t as (select * from tr where gene_id is null), r as (select * from tr where gene_id is not null and {REF}), g as (select gene_id, chr, strand, min(tr_start) as a, max(tr_end) as b from r group by all),
        n as (select transcript_id, max(cast(t.strand = g.strand as int)) as same from t join g on g.chr = t.chr and tr_start < b and a < tr_end group by 1), re as (select distinct chr, strand, s, e from exons join r using (transcript_id)),
        x as (select distinct t.transcript_id from t join exons using (transcript_id) join re on re.chr = t.chr and re.strand = t.strand and exons.s < re.e and re.s < exons.e)
        select transcript_id, case when transcript_id in (select transcript_id from x) then 'genic genomic' when same = 1 then 'intronic' when same = 0 then 'antisense' else 'intergenic' end as novel_type from t left join n using (transcript_id)""",
    "gene_loci": f"""with {_GN}, g as (select gene_id, chr, strand, min(gene_begin) as a, max(gene_finish) as b from gn where chr is not null and strand is not null group by all),
        f as (select *, case when a - max(b) over (partition by chr, strand order by a, b, gene_id rows between unbounded preceding and 1 preceding) <= 300000 then 0 else 1 end as fresh from g),
        l as (select *, sum(fresh) over (partition by chr, strand order by a, b, gene_id rows unbounded preceding) as locus_no from f) select chr, strand, cast(locus_no as bigint) as locus_no, min(a) as start, max(b) as "end", count(*) as n_genes from l group by all""",
    "proportion_z": f"""{_TWO} select *, round((x0 / n0 - x1 / n1) / sqrt(((x0 + x1) / (n0 + n1)) * (1 - (x0 + x1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 5) as z from tw""",
    "binomial_lr": f"{_TWO} select gene_id, event_type, node_a, node_b, round({_LR}, 4) as statistic from tw",
    "adjusted_p": f"""{_TWO}, p as (select gene_id, event_type, node_a, node_b, exp(-round({_LR}, 4) / 2) as p from tw), r as (select *, rank() over (order by p) + count(*) over (partition by p) - 1 as rk, count(*) over () as m from p)
        select gene_id, event_type, node_a, node_b, round(p, 6) as p_value, round(least(min(p * m / rk) over (order by p desc), 1.0), 6) as padj from r""",
    "all_proportion_z": f"""{_ALL_TWO} select *, round((x0 / n0 - x1 / n1) / sqrt(((x0 + x1) / (n0 + n1)) * (1 - (x0 + x1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 5) as z from tw""",
    "all_binomial_lr": f"{_ALL_TWO} select gene_id, event_type, node_a, node_b, via, round({_LR}, 4) as statistic from tw",
    "altsplice_candidates": f"""{_GRAPH}, {M.ME_SQL.format(p='')}, {M.ALL_SQL}, {_SM}, sr as (select i.isoform, sample_name, sum(coalesce(c.coverage, 0)) as reads from ch c join iso i using (gene_id, chr, strand, chain) join sm using (sample_name)
          where sample_group in ('{GROUPS[0]}', '{GROUPS[1]}') group by all),
        ce as (select e.gene, event_type, e.a, e.b, via, sample_name, sum(case when side = 'alternative' then reads else 0 end) as x, sum(reads) as n from evs e join sr using (isoform) group by all),
        k as (select gene, event_type, a, b, via, sum(x) as x, sum(n) as n, count(*) filter (where n >= {MIN_COVERED}) as n_covered from ce group by all)
        select gene as gene_id, event_type, a as node_a, b as node_b, via, cast(x as bigint) as x, cast(n as bigint) as n, cast(n_covered as int) as n_covered from k
        where n >= {MIN_TOTAL} and least(x, n - x) >= n * cast(0.1 as double) and n_covered >= {MIN_SAMPLES}""",
    "isoform_usage": f"""{_W}, {M.sql_iso()}, {_GR}, u as (select gene, isoform, sum(case when sample_group = '{GROUPS[0]}' then reads else 0 end) as r0, sum(case when sample_group = '{GROUPS[1]}' then reads else 0 end) as r1 from sr group by all),
        k as (select gene, least(row_number() over (partition by gene order by r0 + r1 desc, isoform), 10) as k, r0, r1 from u where r0 + r1 > 0), c as (select gene, k, cast(sum(r0) as double) as r0, cast(sum(r1) as double) as r1 from k group by all),
        z as (select *, sum(r0) over w as t0, sum(r1) over w as t1, count(*) over w as n from c window w as (partition by gene)), q as (select *, (r0 + r1) * t0 / (t0 + t1) as e0, (r0 + r1) * t1 / (t0 + t1) as e1, r1 / t1 - r0 / t0 as ch from z where t0 >= 25 and t1 >= 25 and n > 1),
        y as (select *, case when n = 2 then abs(r0 - e0) - least(0.5, abs(r0 - e0)) else abs(r0 - e0) end as o0, case when n = 2 then abs(r1 - e1) - least(0.5, abs(r1 - e1)) else abs(r1 - e1) end as o1,
          row_number() over (partition by gene order by ch desc) as up, row_number() over (partition by gene order by ch) as dn from q),
        v as (select gene, any_value(n) as n, sum(o0 * o0 / e0 + o1 * o1 / e1) as chi2, sum(case when up <= 2 then greatest(ch, 0) else 0 end) as u, sum(case when dn <= 2 then least(ch, 0) else 0 end) as d from y group by 1)
        select gene as gene_id, n as n_isoforms, round(chi2, 4) as chi2, round(case when u >= -d then u else d end, 5) as delta_share from v""",
    "coordination_table": f"""{_GRAPH}, tot as (select e.gene, event_type, e.a, e.b, sum(case when side = 'primary' then reads else 0 end) as pr, sum(case when side = 'alternative' then reads else 0 end) as al from sim e join iso i on i.isoform = e.isoform group by all),
        kp as (select t.*, x.e as st, y.s as en from tot t join seg x on x.gene = t.gene and x.node = t.a join seg y on y.gene = t.gene and y.node = t.b where pr + al >= {MIN_TOTAL} and least(pr, al) >= (pr + al) * cast(0.1 as double)),
        nm as (select s.gene, s.isoform, st, en, s.event_type, s.a, s.b, side = 'alternative' as alt, reads from sim s join kp on kp.gene = s.gene and kp.event_type = s.event_type and kp.a = s.a and kp.b = s.b join iso i on i.isoform = s.isoform where reads > 0),
        pp as (select p.gene, p.st as a_start, p.en as a_end, p.event_type as a_type, p.a as pa, p.b as pb, q.st as b_start, q.en as b_end, q.event_type as b_type, q.a as qa, q.b as qb,
          cast(sum(case when not p.alt and not q.alt then p.reads else 0 end) as bigint) as pri_pri, cast(sum(case when not p.alt and q.alt then p.reads else 0 end) as bigint) as pri_alt, cast(sum(case when p.alt and not q.alt then p.reads else 0 end) as bigint) as alt_pri, cast(sum(case when p.alt and q.alt then p.reads else 0 end) as bigint) as alt_alt
          from nm p join nm q on p.gene = q.gene and p.isoform = q.isoform and q.st - p.en >= 1 group by all)
        select gene as gene_id, a_start, a_end, a_type, b_start, b_end, b_type, pri_pri, pri_alt, alt_pri, alt_alt, round(log2((case when pri_pri = 0 then 1e-9 else pri_pri end) * (case when alt_alt = 0 then 1e-9 else alt_alt end) / ((case when pri_alt = 0 then 1e-9 else pri_alt end) * (case when alt_pri = 0 then 1e-9 else alt_pri end))), 4) as log2_or,
          round(alt_alt / (alt_pri + alt_alt) - (pri_alt + alt_alt) / (pri_pri + pri_alt + alt_pri + alt_alt), 5) as dcpsi_ab, round(alt_alt / (pri_alt + alt_alt) - (alt_pri + alt_alt) / (pri_pri + pri_alt + alt_pri + alt_alt), 5) as dcpsi_ba from pp
        where pri_pri + pri_alt + alt_pri + alt_alt >= {MIN_TOTAL} and least(pri_pri + pri_alt, alt_pri + alt_alt, pri_pri + alt_pri, pri_alt + alt_alt) >= (pri_pri + pri_alt + alt_pri + alt_alt) * cast(0.1 as double)""",
    "rarefaction": f"""{_W}, k as (select sample_name, cast(coverage as double) as k, count(*) as n from tr where coverage > 0 group by all), f as (select *, part / 20 as f from k, (select unnest(range(1, 21)) as part))
        select sample_name, cast(part as int) as part, round(sum(n * (1 - pow(1 - f, k) - k * f * pow(1 - f, k - 1))), 4) as expected from f group by all""",
}
