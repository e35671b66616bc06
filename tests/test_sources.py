import gzip
import pytest

from pyspark.sql import functions as F

from spliceforge.operators import bubbles, collapse
from spliceforge.session import materialize
from spliceforge.sources import alignments as A
from spliceforge.sources import annotation, export, files
from spliceforge.streaming import ingest

GTF = """#!header
c1\tx\tgene\t11\t100\t.\t+\t.\tgene_id "g1"; gene_name "ALPHA";
c1\tx\ttranscript\t11\t100\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tx\texon\t31\t100\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tx\tstart_codon\t12\t14\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tx\tstop_codon\t51\t53\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tx\tCDS\t12\t50\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c2\tx\texon\t5\t9\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c2\tx\tgene\t50\t60\t.\t-\t.\tgene_id "g3";
"""
GFF = """##gff-version 3
NC_1\tx\tgene\t11\t100\t.\t-\t.\tID=gene-A;gene_id=A;Name=ALPHA
NC_1\tx\tmRNA\t11\t100\t.\t-\t.\tID=rna-1;Parent=gene-A
NC_1\tx\texon\t11\t20\t.\t-\t.\tID=e1;Parent=rna-1
NC_1\tx\texon\t31\t100\t.\t-\t.\tID=e2;Parent=rna-1
NC_1\tx\tstart_codon\t90\t92\t.\t-\t.\tParent=rna-1
NC_1\tx\tstop_codon\t15\t17\t.\t-\t.\tParent=rna-1
NC_1\tx\tregion\t1\t900\t.\t+\t.\tID=r
"""


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf.gz").write_bytes(gzip.compress(GTF.encode()))
    genes, trs = annotation.read_gtf(spark, str(tmp_path / "a.gtf.gz"))
    g = {r["gene_id"]: r for r in genes.collect()}
    t = {r["transcript_id"]: r for r in trs.collect()}
    assert (g["g1"]["start"], g["g1"]["end"], g["g1"]["gene_name"], [tuple(e) for e in g["g1"]["short_exons"]]) == (10, 100, "ALPHA", [(10, 20)])
    assert (g["g2"]["start"], g["g2"]["end"], g["g2"]["gene_name"]) == (4, 9, "g2")  # inferred
    assert [tuple(e) for e in t["t1"]["exons"]] == [(10, 20), (30, 100)] and tuple(t["t1"]["cds"]) == (11, 53)
    assert [tuple(e) for e in t["g3"]["exons"]] == [(49, 60)] and t["t2"]["cds"] is None
    assert [tuple(r) for r in annotation.skipped_features(spark, str(tmp_path / "a.gtf.gz")).collect()] == [("CDS", 1)]
    assert annotation.read_gtf(spark, str(tmp_path / "a.gtf.gz"), ["c2"])[0].count() == 2


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    genes, trs = annotation.read_gff3(spark, str(tmp_path / "a.gff3"), aliases={"NC_1": "chr1"})
    g, t = genes.collect(), trs.collect()
    assert len(g) == len(t) == 1 and (g[0]["gene_id"], g[0]["chr"], g[0]["gene_name"]) == ("A", "chr1", "ALPHA")
    assert [tuple(e) for e in t[0]["exons"]] == [(10, 20), (30, 100)] and tuple(t[0]["cds"]) == (14, 92)


def sam(name, flag, pos, cigar, *tags, chrom="c", mapq=60, n=30):
    return "\t".join([name, str(flag), chrom, str(pos), str(mapq), cigar, "*", "0", "0", "A" * n, "*", *tags])


def test_sam_to_isoforms(spark, tmp_path):
    lines = ["@SQ\tSN:c", sam("r1", 0, 11, "10M10N20M", "NM:i:0"), sam("r2", 0, 13, "8M10N20M"), sam("r3", 16, 11, "10M10N20M"), sam("r4", 0, 11, "30M", "NM:i:20"), sam("r5", 4, 0, "*"), sam("r6", 256, 11, "30M"), sam("r7", 0, 11, "30M", mapq=1),
             sam("r8", 0, 11, "10M10N20M", "is:i:5"), sam("r9", 0, 11, "30M", chrom="d"), sam("r10", 0, 11, "5S10M10N15M")]
    (tmp_path / "a.sam").write_text("\n".join(lines))
    reads = A.aligned_reads(A.read_sam(spark, str(tmp_path / "a.sam")), "s", chromosomes=["c"], min_mapqual=10)
    assert {r["qname"] for r in reads.collect()} == {"r1", "r2", "r3", "r8", "r10"}
    assert {r["qname"]: tuple(r["clip"]) for r in reads.where("clip is not null").collect()} == {"r10": (10, -5)}
    trs = A.transcripts_of(reads)
    iso = collapse.isoforms(collapse.with_chain(trs)).collect()
    assert sorted((r["strand"], r["reads"], r["n_transcripts"]) for r in iso) == [("+", 8, 3), ("-", 1, 1)]
    bc = A.barcode_samples(spark, [("AAC", "one")], "p_")
    assert {tuple(r) for r in bc.collect()} == {("AAC", "p_one"), ("GTT", "p_one")}
    (tmp_path / "b.sam").write_text("\n".join([sam("x", 0, 11, "30M", "XC:Z:GTT"), sam("y", 0, 11, "30M", "XC:Z:CCC"), sam("z", 0, 11, "30M")]))
    assert [r["sample_name"] for r in A.aligned_reads(A.read_sam(spark, str(tmp_path / "b.sam")), barcodes=bc).collect()] == ["p_one"]


def test_split_reads(spark, tmp_path):
    lines = []
    for i in range(2):
        lines += [sam(f"f{i}", 0, 101, "50M50S", "SA:Z:x"), sam(f"f{i}", 2048, 5001, "50S50M", chrom="d")]
    lines += [sam("w", 0, 101, "50M50S", "SA:Z:x"), sam("w", 2048, 9001, "50S50M"), sam("one", 0, 101, "50M50S", "SA:Z:x")]
    (tmp_path / "a.sam").write_text("\n".join(lines))
    counts, whole = A.split_reads(A.aligned_reads(A.read_sam(spark, str(tmp_path / "a.sam")), "s"))
    assert [(r["breakpoints"], r["n_reads"], r["n_parts"]) for r in counts.collect()] == [("c:+:150:d:+:5000", 2, 2)]
    assert [(r["qname"], [tuple(e) for e in r["exons"]]) for r in whole.collect()] == [("w", [(100, 150), (9000, 9050)])]


def test_other_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one desc\nACgt\nAC\n>two\nGG\n")
    fa = files.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, fa.collect())) == [("one", "ACGTAC"), ("two", "GG")]
    assert [(r["tile_start"], r["seq"]) for r in files.tiles(fa.where("name = 'one'"), 4, 1).orderBy("tile_no").collect()] == [(0, "ACGTA"), (4, "AC")]
    (tmp_path / "c.csv").write_text("gene_id,transcript_nr,a_coverage,b_coverage,a_sum_coverage\ng,1,5,0,9\ng,2,0,0,9\nh,1,1,2,9\n")
    cov = files.read_coverage(spark, str(tmp_path / "c.csv"))
    assert sorted(map(tuple, cov.collect())) == [("g_1", "a", 5), ("h_1", "a", 1), ("h_1", "b", 2)]
    known, missing = files.import_samples(cov, spark.createDataFrame([("g_1", "x")], "transcript_id string, v string"))
    assert known.count() == 1 and [r[0] for r in missing.collect()] == ["h_1"]
    (tmp_path / "m.sto").write_text("# STOCKHOLM 1.0\n#=GF ID   zf\n#=GF AC   PF1.2\n#=GF DE   Zinc finger\n//\n# STOCKHOLM 1.0\n#=GF ID   y\n#=GF AC   PF2\n//\n")
    meta = {r["accession"]: r["fields"] for r in files.read_family_metadata(spark, str(tmp_path / "m.sto")).collect()}
    assert set(meta) == {"PF1.2", "PF2"} and meta["PF1.2"]["DE"] == "Zinc finger"
    hits = files.read_domain_hits(spark.createDataFrame([(1, '[{"accession":"PF1","name":"n","start":1,"end":3,"score":2.5}]'), (2, "oops")], "k int, j string"), "k", "j")
    assert [tuple(r) for r in hits.collect()] == [(1, "PF1", "n", 1, 3, 2.5)]
    (tmp_path / "h.txt").write_text("hexamer coding noncoding\nAAAAAA 0.5 0.25\n")
    assert [tuple(r) for r in files.read_hexamers(spark, str(tmp_path / "h.txt")).collect()] == [("AAAAAA", 0.5, 0.25)]


def test_gtf_round_trip(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    _, trs = annotation.read_gtf(spark, str(tmp_path / "a.gtf"))
    iso = trs.select("gene_id", "chr", "strand", F.col("transcript_id").alias("isoform"), "exons", F.lit(3).alias("reads"))
    export.write_gtf(iso, str(tmp_path / "out"), gzip=True)
    again = annotation.read_gtf(spark, str(tmp_path / "out"))[1]
    pick = lambda df: sorted((r["gene_id"], r["transcript_id"], r["strand"], str(r["exons"])) for r in df.collect())
    assert pick(again) == pick(trs)


def test_event_files_and_catalog(spark, tmp_path):
    ev = spark.createDataFrame([("g", "c", "+", "ES", 10, 20, 1, 3), ("g", "c", "+", "IR", 5, 9, 0, 1), ("g", "c", "+", "TSS", 5, 9, 0, 1)], "gene_id string, chr string, strand string, event_type string, start long, end long, node_a int, node_b int")
    export.write_events(ev, str(tmp_path / "ev"))
    assert {p.name for p in (tmp_path / "ev").iterdir() if p.is_dir()} == {"file=SE", "file=RI"}
    export.save_catalog({"genes": ev}, str(tmp_path / "cat"))
    assert export.load_catalog(spark, str(tmp_path / "cat"), ["genes"])["genes"].count() == 3


def test_layouts_of_events(spark, tmp_path):
    from tests.test_structure import gene, graph

    chains = {
        "SE": [[(0, 10), (50, 60)], [(5, 10), (20, 30), (50, 70)]], "RI": [[(0, 10), (20, 30), (40, 50)], [(0, 30), (40, 50)]],
        "A5SS": [[(0, 10), (50, 60), (80, 90)], [(0, 15), (50, 60), (80, 90)]], "A3SS": [[(0, 10), (50, 60), (80, 90)], [(0, 10), (45, 60), (80, 90)]],
        "MXE": [[(0, 10), (40, 48), (60, 70)], [(2, 10), (20, 30), (60, 66)]],
    }
    want = {
        "SE": [(20, 30), (5, 10), (50, 70), None], "RI": [(0, 30), (0, 10), (20, 30), None], "A5SS": [(0, 15), (0, 10), (50, 60), None], "A3SS": [(45, 60), (50, 60), (0, 10), None], "MXE": [(20, 30), (40, 48), (2, 10), (60, 66)],
    }
    # the second isoform has most reads; another exon behind SE's and RI's keeps B from being the last node
    iso = None
    for k, (name, both) in enumerate(chains.items()):
        last = [(100, 110)] if name in ("SE", "RI") else []
        one = gene(spark, [[*c, *last] for c in both], reads=[3, 8], name=name).withColumn("isoform", F.col("isoform") + 10 * k)
        iso = one if iso is None else iso.unionByName(one)
    segs, path, strand = graph(iso)
    sides = bubbles.simple_events(path, strand).withColumn("via", F.lit(None).cast("int")).unionByName(bubbles.exclusive_events(path).withColumn("via", F.col("via").cast("int")))
    paths = materialize(export.event_paths(sides, iso, path, segs), "paths")
    rows = [r for r in export.event_layouts(paths).collect() if r["file"] == r["gene_id"]]
    exons = {r["file"]: [None if r[f"x{i}_start"] is None else (r[f"x{i}_start"], r[f"x{i}_end"]) for i in range(1, 5)] for r in rows}
    assert exons == want and len(rows) == len(want)
    lines = export.event_gff_lines(paths, iso.select("gene_id", "chr", "strand").distinct()).where("event_id like 'MXE%_ME_%'").orderBy("no").collect()
    lines = [r["value"].split("\t") for r in lines]
    assert [x[2:5] for x in lines] == [
        ["gene", "3", "66"], ["mRNA", "3", "66"], ["exon", "3", "10"], ["exon", "41", "48"], ["exon", "61", "66"], ["mRNA", "3", "66"], ["exon", "3", "10"], ["exon", "21", "30"], ["exon", "61", "66"]]
    assert lines[1][8].endswith("ID=MXE:10-60_ME_3.A0") and "Parent=" in lines[2][8]


def test_a_catalog_of_another_version_is_refused(spark, tmp_path):
    export.save_catalog({"t": spark.range(3)}, str(tmp_path / "cat"))
    assert export.load_catalog(spark, str(tmp_path / "cat"), ["t"])["t"].count() == 3
    spark.createDataFrame([("0",)], "value string").write.mode("overwrite").text(str(tmp_path / "cat" / export.VERSION_FILE))
    with pytest.raises(ValueError):
        export.load_catalog(spark, str(tmp_path / "cat"), ["t"])


def test_ingest_keeps_the_latest_and_can_be_repeated(spark, tmp_path):
    schema = "transcript_id long, sample_name string, coverage long, loaded_at timestamp"
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d}"))
    a = spark.createDataFrame([(1, "s", 5), (2, "s", 7)], "transcript_id long, sample_name string, coverage long").withColumn("loaded_at", day(1))
    b = spark.createDataFrame([(1, "s", 9), (1, "s", 9)], "transcript_id long, sample_name string, coverage long").withColumn("loaded_at", day(2))
    like = spark.createDataFrame([], schema)
    for k, df in enumerate((a, b)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.transcript_stream(spark, str(tmp_path / "in"), like), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    got = ingest.stored_current(spark, str(tmp_path / "store"), "coverage")
    assert sorted(map(tuple, got.collect())) == [(1, 9), (2, 7)]
    counts = ingest.sample_counts(ingest.transcript_stream(spark, str(tmp_path / "in"), like))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n"), F.sum("reads")).first()[:] == (3, 21)
