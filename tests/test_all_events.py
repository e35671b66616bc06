"""Events of all types in the tests, tables and exports."""

import pytest

import __spark_entry__ as entry
from spliceforge.operators import bubbles
from spliceforge.plans import summary
from tests.test_entry import DIR, cells, duck  # noqa: F401
from tests.test_structure import gene, graph


@pytest.mark.parametrize("name", ["all_event_psi", "all_proportion_z", "all_binomial_lr"])
def test_all_types_equal_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    assert {"ME", "TSS", "PAS"} <= {r["event_type"] for r in rows}
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert cells(rows) == cells([[r[i] for i in at] for r in rel.fetchall()])


def test_end_events_by_sample(spark):
    iso = gene(spark, [[(0, 10), (40, 50), (60, 70)], [(20, 30), (40, 50), (60, 70)], [(40, 55)]])
    segs, path, strand = graph(iso)
    reads = spark.createDataFrame([("g", 0, "s", 5), ("g", 1, "s", 7), ("g", 2, "s", 11), ("g", 1, None, 3), ("g", 2, "u", 2)], "gene_id string, isoform long, sample_name string, reads long")
    got = bubbles.with_coordinates(bubbles.end_event_totals(path, strand, reads, ("sample_name",)), segs).where("event_type = 'TSS'").collect()
    assert {(r["start"], r["sample_name"]): (r["primary_reads"], r["alternative_reads"]) for r in got} == {
        (0, "s"): (18, 5), (20, "s"): (16, 7), (0, None): (3, 0), (20, None): (0, 3), (0, "u"): (2, 0), (20, "u"): (2, 0)}


def test_splicing_tests_take_all_types(spark):
    assert {"ES", "ME", "TSS", "PAS"} <= {r["event_type"] for r in summary.altsplice_test(spark, DIR).select("event_type").distinct().collect()}
    kinds = summary.coordination_test(spark, DIR).select("a_type").distinct().collect()
    assert "ME" in {r["a_type"] for r in kinds}
