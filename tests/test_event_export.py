"""Exports and frequent events of all types."""

from spliceforge.plans import annotation, structure

DIR = "/root/testdata/sf0.001"


def test_export_has_exclusive_events(spark):
    rows = annotation.all_event_export(spark, DIR).collect()
    me = [r for r in rows if r["file"] == "MXE"]
    want = structure.exclusive_events(spark, DIR).where("primary_reads + alternative_reads >= 20 and least(primary_reads, alternative_reads) > (primary_reads + alternative_reads) * 0.1D").collect()
    assert me and sorted(r["row_id"] for r in me) == list(range(1, len(me) + 1))
    assert sorted((r["gene_id"], r["start"], r["end"], r["via"]) for r in me) == sorted((r["gene_id"], r["start"], r["end"], r["via"]) for r in want)


def test_frequent_events_have_ends(spark):
    assert {"TSS", "PAS"} <= {r["event_type"] for r in structure.all_frequent_events(spark, DIR).select("event_type").distinct().collect()}
