"""Reads to genes: isoforms of the reads, the gene of each, junctions corrected by the reference, and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceforge.functions.intervals import introns
from spliceforge.operators import collapse
from spliceforge.operators.assign import best_genes, novel_genes, novel_types
from spliceforge.operators.novelty import classify_transcripts
from spliceforge.session import materialize

NOVEL = 4


def junction_shifts(rows: DataFrame, references: DataFrame, size: int = 5) -> DataFrame:
    """transcript_id, intron_no (from 0), shift: introns that the reference chains of the gene lack, but have if both ends move alike by at most
    ``size``; the least such move, to the left where two are equal.

    ``rows``: transcript_id, gene_id, exons; ``references``: gene_id, exons. As both ends move alike, the length is part of the key.
    """
    each = rows.select("transcript_id", "gene_id", F.posexplode(introns(F.col("exons"))).alias("intron_no", "i"))
    each = each.select("transcript_id", "gene_id", "intron_no", F.col("i.donor").alias("donor"), (F.col("i.acceptor") - F.col("i.donor")).alias("len"))
    known = references.select("gene_id", F.inline(introns(F.col("exons")))).select("gene_id", (F.col("acceptor") - F.col("donor")).alias("len"), F.col("donor").alias("ref_donor")).distinct()
    near = each.join(known, ["gene_id", "len"]).withColumn("shift", F.col("ref_donor") - F.col("donor")).where(F.abs("shift") <= size)
    best = near.groupBy("transcript_id", "intron_no").agg(F.min_by("shift", F.abs(F.col("shift")) * 2 + (F.col("shift") > 0).cast("int")).alias("shift"))
    return best.where("shift != 0")


def place(reads: DataFrame, references: DataFrame, fuzzy_junction: int = 5, min_exonic_coverage: float = 0.25, prefix: str = "PB_novel_") -> tuple[DataFrame, DataFrame]:
    """Isoforms of ``reads`` in genes, and which isoform each read became: (gene_id, isoform, chr, strand, exons, n_transcripts, reads, novelty,
    subcategories) and (transcript_id, isoform).

    ``reads``: transcript_id (int64, unique), chr, strand, exons, coverage; ``references``: gene_id, chr, strand, exons, a row a chain. Reads of equal introns
    are one isoform (single exons if they overlap); an isoform goes to the gene of :func:`best_genes`; there its junctions are corrected by
    :func:`junction_shifts` and isoforms that have become equal are joined; what is left is compared with the gene's chains.
    Isoforms without a gene form novel ones, of category 4 and a subcategory by where they lie. Empty tables give empty results.
    """
    lone = materialize(collapse.with_chain(reads.select("transcript_id", "chr", "strand", "exons", "coverage").withColumn("gene_id", F.lit("-"))), "read-chains")
    iso = materialize(collapse.isoforms(lone), "read-isoforms")
    chains = iso.select(F.col("isoform").alias("transcript_id"), "chr", "strand", "exons", "reads", "n_transcripts", "chain")
    best = materialize(best_genes(chains, references, min_exonic_coverage).select("transcript_id", "gene_id"), "read-genes")
    homed = chains.join(best, "transcript_id")
    moved = collapse.shift_junctions(homed, junction_shifts(homed, references, fuzzy_junction)).withColumn("first", F.col("chain"))
    moved = materialize(moved.withColumn("chain", F.when(F.size("exons") > 1, collapse.chain_text(F.col("exons"))).otherwise(F.col("first"))), "moved-isoforms")
    key = ["gene_id", "chr", "strand", "chain"]
    joined = moved.groupBy(*key).agg(F.max_by(F.struct(F.col("transcript_id").alias("isoform"), "exons"), F.struct(F.col("reads"), -F.col("transcript_id"))).alias("top"), F.sum("reads").alias("reads"), F.sum("n_transcripts").alias("n_transcripts"))
    joined = materialize(joined.select(*key, "top.*", "reads", "n_transcripts"), "joined-isoforms")
    known = joined.select(F.col("isoform").alias("transcript_id"), "gene_id", "chr", "strand", "exons")
    classes = classify_transcripts(known, references.select("gene_id", "chr", "strand", "exons")).withColumnRenamed("transcript_id", "isoform")
    columns = ["gene_id", "isoform", "chr", "strand", "exons", "n_transcripts", "reads", "novelty", "subcategories"]
    in_genes = joined.join(classes, "isoform", "left").select(columns)
    rest = materialize(chains.join(best, "transcript_id", "left_anti"), "homeless-isoforms")
    named = novel_genes(rest, prefix).join(novel_types(rest, references), "transcript_id")
    homeless = rest.join(named, "transcript_id").select(F.col("novel_gene").alias("gene_id"), F.col("transcript_id").alias("isoform"), "chr", "strand", "exons", "n_transcripts", "reads", F.lit(NOVEL).alias("novelty"), F.col("novel_type").alias("subcategories"))
    to_joined = moved.join(joined.select(*key, "isoform"), key).select("transcript_id", F.col("isoform").alias("into"))
    member = lone.join(iso.select("chr", "strand", "chain", "isoform"), ["chr", "strand", "chain"]).select("transcript_id", "isoform")
    member = member.join(to_joined.withColumnRenamed("transcript_id", "isoform"), "isoform", "left").select("transcript_id", F.coalesce("into", "isoform").alias("isoform"))
    return in_genes.unionByName(homeless), member


def import_reads(reads: DataFrame, references: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Isoforms and coverage (gene_id, isoform, sample_name, reads) of aligned reads, see :func:`spliceforge.sources.alignments.transcripts_of`."""
    named = materialize(reads.withColumn("transcript_id", F.xxhash64("sample_name", "transcript_id")), "named-reads")
    iso, member = place(named, references, **options)
    iso = materialize(iso, "placed-isoforms")
    rows = named.select("transcript_id", "sample_name", "coverage").join(member, "transcript_id").groupBy("isoform", "sample_name").agg(F.sum("coverage").alias("reads"))
    return iso, iso.select("gene_id", "isoform").join(rows, "isoform").select("gene_id", "isoform", "sample_name", "reads")
