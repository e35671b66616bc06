"""Readthrough into another gene, over frames."""

from spliceforge.operators.novelty import classify_transcripts

EXONS = "array<struct<start:long,end:long>>"


def test_exons_of_another_gene(spark):
    a, b = [(10, 20), (30, 40), (50, 60)], [(100, 110), (120, 130), (140, 150)]
    ref = spark.createDataFrame([("a", "c", "+", a), ("b", "c", "+", b), ("m", "c", "-", b)], f"gene_id string, chr string, strand string, exons {EXONS}")
    tr = spark.createDataFrame(
        [(1, "a", "c", "+", [*a[:2], (120, 130), (140, 150)]), (2, "a", "c", "+", a), (3, "a", "c", "+", [*a[:2], (70, 80), (90, 95)]), (4, "m", "c", "-", b)],
        f"transcript_id long, gene_id string, chr string, strand string, exons {EXONS}",
    )
    got = {r["transcript_id"]: (r["novelty"], "readthrough fusion" in r["subcategories"].split(",")) for r in classify_transcripts(tr, ref).collect()}
    assert got[1] == (4, True) and got[2] == (0, False) and got[4] == (0, False) and not got[3][1]
