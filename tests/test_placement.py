"""From SAM lines to placed isoforms, selections, and expressions over two chains."""

import pytest
from pyspark.sql import functions as F

from spliceforge.functions import intervals as X
from spliceforge.functions.filters import Filters
from spliceforge.operators import select
from spliceforge.operators.placement import import_reads
from spliceforge.sources import alignments as A
from spliceforge.sources import annotation

EXONS = "array<struct<start:long,end:long>>"


def sam(name, pos, cigar, flag=0, tags="NM:i:0"):
    return "\t".join([name, str(flag), "c", str(pos + 1), "60", cigar, "*", "0", "0", "A" * 10, "*", tags])


def test_reads_to_isoforms(spark, tmp_path):
    lines = [
        sam("r1", 100, "50M70N40M70N50M"), sam("r2", 104, "46M70N40M70N44M", tags="NM:i:0\tis:i:4"),  # the reference chain
        sam("r3", 100, "52M70N40M68N50M"),  # first intron two bases off, second another length
        sam("r4", 100, "50M180N50M"),  # leaves out the middle exon
        sam("r5", 1000, "60M"), sam("r6", 1010, "60M"), sam("r7", 2000, "30M"), sam("r8", 105, "40M", flag=16), sam("r9", 5, "9M", flag=4),
    ]
    (tmp_path / "a.sam").write_text("@HD\n" + "\n".join(lines) + "\n")
    ref = spark.createDataFrame([("g", "c", "+", [(100, 150), (220, 260), (330, 380)])], f"gene_id string, chr string, strand string, exons {EXONS}")
    reads = A.transcripts_of(A.aligned_reads(A.read_sam(spark, str(tmp_path / "a.sam")), "s"))
    iso, cov = import_reads(reads, ref)
    got = {tuple(map(tuple, r["exons"])): r for r in iso.collect()}
    full, skip = got[(104, 150), (220, 260), (330, 374)], got[(100, 150), (330, 380)]
    assert (full["gene_id"], full["novelty"], full["subcategories"], full["reads"]) == ("g", 0, "FSM", 5)
    assert (skip["gene_id"], skip["novelty"], skip["subcategories"]) == ("g", 2, "exon skipping")
    off = got[(100, 150), (220, 262), (330, 380)]  # r3's first junction is moved onto the reference's
    assert off["gene_id"] == "g" and off["novelty"] == 3
    one, other = got[((1000, 1060),)], got[((2000, 2030),)]
    assert one["n_transcripts"] == 2 and one["novelty"] == 4 and one["subcategories"] == "intergenic" and one["gene_id"] != other["gene_id"]
    assert got[((105, 145),)]["subcategories"] == "antisense"
    assert cov.agg(F.sum("reads")).first()[0] == 11 and {r["sample_name"] for r in cov.collect()} == {"s"}


def test_selections(spark):
    f = Filters()
    f.add("LONG", "tr_end - tr_start > 50")
    f.add("KNOWN", "is_annotated", "gene")
    f.add("BIG", "len(exons) > 1", "reference")
    rows = spark.createDataFrame([(1, "g", "N", "c", 0, 100, 5, True, [1]), (2, "g", "N", "c", 200, 230, None, True, [1, 2]), (3, "h", None, "d", 0, 90, 9, False, [1, 2])],
                                 "transcript_id long, gene_id string, gene_name string, chr string, tr_start int, tr_end int, coverage long, is_annotated boolean, exons array<int>")
    ids = lambda **k: sorted(r["transcript_id"] for r in select.select_transcripts(rows, f, **k).collect())
    assert ids(query="LONG") == [1, 3] and ids(query="LONG and KNOWN") == [1] and ids(region="c:100-300") == [2] and ids(region=("c", 99, 201)) == [1, 2] and ids(region="d") == [3]
    assert ids(names=["N"]) == [1, 2] and ids(names=["h"]) == [3] and ids(min_coverage=6) == [3] and ids(max_coverage=5) == [1, 2]
    assert {r["gene_id"]: r["transcript_ids"] for r in select.select_transcripts(rows, f, genewise=True).collect()} == {"g": [1, 2], "h": [3]}
    genes = rows.groupBy("gene_id", "gene_name", "chr").agg(F.min("tr_start").alias("start"), F.max("tr_end").alias("end"), F.sum("coverage").alias("coverage"), F.max("is_annotated").alias("is_annotated"))
    assert [r["gene_id"] for r in select.select_genes(genes, f, query="KNOWN", region="c:0-10", min_coverage=5).collect()] == ["g"]
    assert sorted(r["transcript_id"] for r in select.select_references(rows, f, query="BIG").collect()) == [2, 3]
    with pytest.raises(ValueError):
        select.region_of("c:1-")


def test_two_chains(spark):
    pairs = [([(0, 10), (20, 30)], [(5, 10), (20, 25)], 2, 10, True), ([(0, 100)], [(50, 150)], 0, 50, False), ([(0, 100)], [(20, 110)], 0, 80, True), ([(0, 10), (20, 30)], [(8, 12), (40, 50)], 0, 2, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], f"i int, a {EXONS}, b {EXONS}")
    rows = df.select("i", X.shared_sites(F.col("a"), F.col("b")).alias("s"), X.shared_bases(F.col("a"), F.col("b")).alias("n"), X.is_same_gene(F.col("a"), F.col("b")).alias("g"), X.is_exonic(F.col("a"), F.lit(10)).alias("x")).collect()
    assert {r["i"]: (r["s"], r["n"], r["g"]) for r in rows} == {i: p[2:] for i, p in enumerate(pairs)} and all(r["x"] for r in rows)


def test_reference_formats(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('c\tx\texon\t1\t10\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    genes, _ = annotation.read_reference(spark, str(tmp_path / "a.gtf"))
    assert [r["gene_id"] for r in genes.collect()] == ["g"]
    with pytest.raises(ValueError):
        annotation.read_reference(spark, "x.bed")
