"""Command line: ``python -m spliceforge import|table|gtf|test``; a catalog is a folder of tables."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.functions.filters import default_filters
from spliceforge.operators import bubbles, differential, segments
from spliceforge.operators.placement import import_reads
from spliceforge.operators.select import select_transcripts
from spliceforge.session import materialize
from spliceforge.sources import alignments, annotation, export

TABLES = ["isoforms", "coverage", "samples"]


def import_catalog(spark: SparkSession, reference: str, sams: dict[str, str], groups: dict[str, str], out: str, fuzzy_junction: int = 5) -> None:
    """Reads the SAM file of each sample, places the reads in the genes of the reference and writes a catalog."""
    _, known = annotation.read_reference(spark, reference)
    known = materialize(known.select("gene_id", "chr", "strand", "exons"), "reference")
    reads = [alignments.transcripts_of(alignments.aligned_reads(alignments.read_sam(spark, path), name)) for name, path in sams.items()]
    iso, coverage = import_reads(reduce(DataFrame.unionByName, reads), known, fuzzy_junction=fuzzy_junction)
    coverage = materialize(coverage, "coverage")
    counted = coverage.groupBy("sample_name").agg(F.sum("reads").alias("n_reads"))
    named = spark.createDataFrame([(s, groups.get(s)) for s in sams], "sample_name string, sample_group string").join(counted, "sample_name", "left")
    export.save_catalog({"isoforms": iso, "coverage": coverage, "samples": named}, out)


def filtered(tables: dict[str, DataFrame], query: str | None, region: str | None) -> DataFrame:
    """The isoforms of a catalog that pass, with the columns that tags use; tags of genome and graph aren't in a catalog."""
    iso = tables["isoforms"]
    total = iso.groupBy("gene_id").agg(F.sum("reads").alias("gene_coverage"))
    rows = iso.join(total, "gene_id").withColumns({
        "transcript_id": F.col("isoform"), "coverage": F.col("reads"), "category": F.col("novelty"), "subs": F.split("subcategories", ","), "tr_start": F.get("exons", F.lit(0))["start"],
        "tr_end": F.try_element_at("exons", F.lit(-1))["end"]})
    return select_transcripts(rows, default_filters(), region=region, query=query)


def transcript_table(tables: dict[str, DataFrame], rows: DataFrame, groups: bool = False, tpm: bool = False, pseudocount: int = 0) -> DataFrame:
    """A row an isoform, with a column of reads (and of reads per million) for each sample, or for each group.

    The driver reads the sample table, a row a sample, for the names of the columns.
    """
    by = "sample_group" if groups else "sample_name"
    size = {r[by]: r["n"] for r in tables["samples"].where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n_reads").alias("n")).collect()}
    long = tables["coverage"].join(tables["samples"].select("sample_name", "sample_group"), "sample_name")
    wide = long.groupBy("isoform").pivot(by, sorted(size)).agg(F.sum("reads"))
    text = lambda f: F.array_join(F.transform("exons", lambda x: x[f].cast("string")), ",")
    base = rows.select("gene_id", "isoform", "chr", "strand", "tr_start", "tr_end", F.size("exons").alias("num_exons"), text("start").alias("exon_starts"), text("end").alias("exon_ends"), "novelty", "subcategories", "reads")
    reads = lambda s: F.coalesce(F.col(f"`{s}`"), F.lit(0))
    end = "_sum" if groups else ""
    each = [reads(s).alias(f"{s}{end}_coverage") for s in sorted(size)]
    if tpm:
        n_rows = base.count() if pseudocount else 0
        each += [((reads(s) + pseudocount) / F.lit(float((size[s] or 0) + pseudocount * n_rows) or None) * 1e6).alias(f"{s}{end}_tpm") for s in sorted(size)]
    return base.join(wide, "isoform", "left").select(*base.columns, *each)


def splicing(tables: dict[str, DataFrame], groups: dict[str, list[str]], **options) -> DataFrame:
    iso = tables["isoforms"]
    rows = segments.exon_rows(iso)
    segs = materialize(segments.segments(rows), "segments")
    path = segments.paths(materialize(segments.spans(rows, segs), "spans"))
    strand, reads = iso.groupBy("gene_id").agg(F.first("strand").alias("strand")), tables["coverage"]
    via = lambda df: df.withColumn("via", F.lit(None).cast("int"))
    by = ("sample_name",)
    me = bubbles.event_totals(bubbles.exclusive_events(path), reads, by).withColumn("via", F.col("via").cast("int"))
    totals = via(bubbles.simple_event_totals(path, strand, reads, by)).unionByName(me).unionByName(via(bubbles.end_event_totals(path, strand, reads, by)))
    return bubbles.with_coordinates(differential.splicing_test(totals, groups, **options), segs)


def pairs_of(items: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in items)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser("spliceforge")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("import", help="SAM files and a reference to a catalog")
    one.add_argument("--reference", required=True)
    one.add_argument("--sam", nargs="+", required=True, metavar="SAMPLE=PATH")
    one.add_argument("--group", nargs="*", default=[], metavar="SAMPLE=GROUP")
    one.add_argument("--fuzzy-junction", type=int, default=5)
    for name, text in (("table", "transcripts as CSV"), ("gtf", "transcripts as GTF"), ("test", "differential splicing as CSV")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--catalog", required=True)
        s.add_argument("--query")
        s.add_argument("--region")
        if name == "table":
            s.add_argument("--by-group", action="store_true")
            s.add_argument("--tpm", action="store_true")
        if name == "test":
            s.add_argument("--groups", nargs=2, required=True)
            s.add_argument("--test", default="auto", choices=["auto", *differential.TESTS])
            s.add_argument("--min-total", type=int, default=100)
    for s in sub.choices.values():
        s.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("spliceforge").getOrCreate()
    if a.command == "import":
        import_catalog(spark, a.reference, pairs_of(a.sam), pairs_of(a.group), a.out, a.fuzzy_junction)
        return
    tables = export.load_catalog(spark, a.catalog, TABLES)
    rows = filtered(tables, a.query, a.region)
    if a.command == "gtf":
        export.write_gtf(rows, a.out)
    elif a.command == "table":
        transcript_table(tables, rows, a.by_group, a.tpm).write.csv(a.out, header=True)
    else:
        of = {g: [r["sample_name"] for r in tables["samples"].where(F.col("sample_group") == g).collect()] for g in a.groups}
        kept = tables | {"isoforms": rows.select(tables["isoforms"].columns)}
        splicing(kept, of, test=a.test, min_total=a.min_total).write.csv(a.out, header=True)


if __name__ == "__main__":
    main()
