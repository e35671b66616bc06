"""Selection of genes, transcripts and reference transcripts by region, names, coverage and tags, in one call."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceforge.functions.filters import Filters


def region_of(text: str | tuple[str, int, int]) -> tuple[str, int | None, int | None]:
    """(chr, start, end) of ``chr:start-end`` or ``chr``; raises ValueError for anything else."""
    if not isinstance(text, str):
        return tuple(text)
    m = re.fullmatch(r"([^:]+)(?::(\d+)-(\d+))?", text)
    if not m:
        raise ValueError(f"{text!r} is no region")
    return m[1], *(int(x) if x else None for x in m.groups()[1:])


def _in_region(rows: DataFrame, region, start: str, end: str) -> DataFrame:
    chrom, a, b = region_of(region)
    rows = rows.where(F.col("chr") == chrom)
    return rows if a is None else rows.where((F.col(start) < b) & (F.col(end) > a))


def _of_genes(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose gene_id or gene_name is one of ``names``, a list that the caller holds."""
    by_name = F.col("gene_name").isin(names) if "gene_name" in rows.columns else F.lit(False)
    return rows.where(F.coalesce(F.col("gene_id").isin(names) | by_name, F.lit(False)))


def _covered(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    n = F.coalesce("coverage", F.lit(0))
    rows = rows if low is None else rows.where(n >= low)
    return rows if high is None else rows.where(n <= high)


def select_genes(genes: DataFrame, filters: Filters, region=None, query: str | None = None, names: list[str] | None = None, min_coverage: int | None = None, max_coverage: int | None = None) -> DataFrame:
    """Genes (gene_id, chr, start, end, coverage and what the tags of ``query`` use) that pass all that is given."""
    rows = genes if region is None else _in_region(genes, region, "start", "end")
    rows = rows if names is None else _of_genes(rows, names)
    rows = _covered(rows, min_coverage, max_coverage)
    return rows if query is None else rows.where(filters.query(query, "gene"))


def select_transcripts(transcripts: DataFrame, filters: Filters, region=None, query: str | None = None, names: list[str] | None = None, min_coverage: int | None = None, max_coverage: int | None = None, genewise: bool = False) -> DataFrame:
    """Transcripts (gene_id, chr, tr_start, tr_end, coverage and what the tags use) that pass; ``query`` may use tags of transcripts and genes.

    ``genewise`` gives a row a gene: gene_id and the sorted transcript_ids that pass, as an array; one gene's array has its
    transcripts' ids only.
    """
    rows = transcripts if region is None else _in_region(transcripts, region, "tr_start", "tr_end")
    rows = rows if names is None else _of_genes(rows, names)
    rows = _covered(rows, min_coverage, max_coverage)
    rows = rows if query is None else rows.where(filters.query(query, "transcript", "gene"))
    return rows.groupBy("gene_id").agg(F.sort_array(F.collect_list("transcript_id")).alias("transcript_ids")) if genewise else rows


def select_references(references: DataFrame, filters: Filters, region=None, query: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Reference transcripts (gene_id, chr, tr_start, tr_end and what the tags use) that pass; ``query`` may use tags of references and genes."""
    rows = references if region is None else _in_region(references, region, "tr_start", "tr_end")
    rows = rows if names is None else _of_genes(rows, names)
    return rows if query is None else rows.where(filters.query(query, "reference", "gene"))
