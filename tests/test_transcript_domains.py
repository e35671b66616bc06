"""Domains on transcripts of the tables."""

from pyspark.sql import functions as F

from spliceforge.plans import annotation
from spliceforge.plans import model as M

DIR = "/root/testdata/sf0.001"


def test_domain_on_a_transcript(spark, tmp_path):
    spark.read.parquet(f"{DIR}/transcript.parquet").write.parquet(f"{tmp_path}/transcript.parquet")
    t = M.transcripts(spark, DIR).where("size(exons) > 1").orderBy("transcript_id").first()
    (a, b), (c, e) = t["exons"][:2]
    row = spark.read.parquet(f"{DIR}/example_anno_domains.parquet").where("domain_id is not null").limit(1)
    put = {"chrom": t["chr"], "chromstart": b - 1, "blocksizes": "1,1", "chromstarts": f"0,{c - b + 1}"}
    types = dict(row.dtypes)
    row.withColumns({k: F.lit(v).cast(types[k]) for k, v in put.items()}).write.parquet(f"{tmp_path}/example_anno_domains.parquet")
    got = {r["transcript_id"]: (r["tr_start"], r["tr_end"]) for r in annotation.transcript_domains(spark, str(tmp_path)).collect()}
    assert got[t["transcript_id"]] == (b - a - 1, b - a + 1)
