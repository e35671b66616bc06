"""Both ends of transcripts are unified."""

from spliceforge.operators.ends import unify_ends
from spliceforge.plans import annotation

DIR = "/root/testdata/sf0.001"


def test_both_ends_come_out(spark):
    got = {(r["kind"], r["single"]) for r in annotation.unified_ends(spark, DIR).selectExpr("kind", "junction is null as single").distinct().collect()}
    assert got == {("start", True), ("start", False), ("end", True), ("end", False)}


def test_bounds_by_majority(spark):
    data = [("g", "10-200", 1, [(0, 10), (200, 300)], 0, 300, 50), ("g", "10-200", 2, [(2, 10), (200, 306)], 2, 306, 5), ("g", "mono", 3, [(400, 500)], 400, 500, 1)]
    rows = spark.createDataFrame(data, "gene_id string, chain string, transcript_id long, exons array<struct<start:long,end:long>>, tr_start long, tr_end long, coverage long")
    ends = annotation._end_reads(rows).collect()
    assert {(r["transcript_id"], r["kind"], r["junction"], r["pos"]) for r in ends} == {
        (1, "start", 10, 0), (1, "end", 200, 300), (2, "start", 10, 2), (2, "end", 200, 306), (3, "start", None, 400), (3, "end", None, 500)}
    got = {r["chain"]: (r["iso_start"], r["iso_end"]) for r in annotation.majority_bounds(rows).collect()}
    assert got == {"10-200": (0, 300), "mono": (400, 500)}
    assert unify_ends(annotation._end_reads(rows).groupBy("gene_id", "kind", "junction", "pos").sum("coverage").withColumnRenamed("sum(coverage)", "n")).count() == 6
