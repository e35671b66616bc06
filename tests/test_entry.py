"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from spliceforge.plans import annotation, problems, structure, summary

DIR = "/root/testdata/sf0.001"
CORE = {n for m in (problems, structure, summary, annotation) for n in m.SQL}
QUICK = sorted(CORE & {
    "p2_found", "p3_found", "p3_gene_totals", "p4_found", "p7_found", "p7_domains", "isoform_table", "gene_segments", "splice_events", "exclusive_events", "end_events", "isoform_fragments", "fsm_match", "transcript_positions",
    "transcript_table", "filter_query", "filter_stats", "hist_exons", "exon_depth", "novel_type", "gene_loci", "isoform_usage", "coordination_table", "domain_containment", "domain_label_sets", "gtf_export", "window_content",
})


def cells(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted("|".join(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert cells(got) == cells([[r[i] for i in at] for r in rel.fetchall()])


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
