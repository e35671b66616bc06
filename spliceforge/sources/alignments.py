"""Alignments from SAM text: filters, exon blocks, and isoforms per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.functions import cigar as C
from spliceforge.functions.sequence import reverse_complement

UNMAPPED, REVERSE, SUPPLEMENTARY = 0x4, 0x10, 0x800
#: Secondary, failed or duplicate.
UNWANTED = 0x700


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chr, pos (0-based), mapq, cigar, query_length, tags (map) of SAM lines; header lines are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%'").select(c.alias("c")).where(F.size("c") >= 11)
    tags = F.transform(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    g = lambda i: F.get("c", F.lit(i))
    seq = F.when(g(9) != "*", F.length(g(9)))
    return rows.select(g(0).alias("qname"), g(1).try_cast("int").alias("flag"), g(2).alias("chr"), (g(3).try_cast("long") - 1).alias("pos"), g(4).try_cast("int").alias("mapq"), g(5).alias("cigar"), seq.alias("query_length"), F.map_from_entries(F.array_distinct(tags)).alias("tags"))


def barcode_samples(spark: SparkSession, rows: list[tuple[str, str]], prefix: str = "") -> DataFrame:
    """barcode, sample_name for barcodes as given and reversed."""
    one = spark.createDataFrame(rows, "barcode string, sample_name string").withColumn("sample_name", F.concat(F.lit(prefix), "sample_name"))
    return one.unionByName(one.withColumn("barcode", reverse_complement(F.col("barcode")))).dropDuplicates(["barcode"])


def aligned_reads(sam: DataFrame, sample_name: str | None = None, barcodes: DataFrame | None = None, chromosomes: list[str] | None = None, min_mapqual: int = 0, min_align_fraction: float = 0.75) -> DataFrame:
    """qname, sample_name, chr, strand, exons, weight, clip, is_part of the reads that pass.

    Dropped in this order: unmapped, secondary, failed or duplicate reads, low mapping quality, no known barcode (where barcodes are
    given), other chromosomes, too many mismatches. is_part marks alignments of split reads. Weight is the tag ``is``, else 1.
    """
    rows = sam.where(((F.col("flag").bitwiseAND(UNMAPPED | UNWANTED)) == 0) & (F.col("mapq") >= min_mapqual))
    if barcodes is not None:
        rows = rows.withColumn("barcode", F.col("tags")["XC"]).join(barcodes, "barcode")
    else:
        rows = rows.withColumn("sample_name", F.lit(sample_name))
    if chromosomes:
        rows = rows.where(F.col("chr").isin(chromosomes))
    ops = C.cigar_ops(F.col("cigar"))
    part = ((F.col("flag").bitwiseAND(SUPPLEMENTARY)) != 0) | F.col("tags")["SA"].isNotNull()
    rows = rows.withColumns({"ops": ops, "is_part": part, "strand": F.when((F.col("flag").bitwiseAND(REVERSE)) != 0, "-").otherwise("+")})
    nm = F.coalesce(F.col("tags")["NM"].try_cast("double"), F.lit(0.0))
    rows = rows.where(F.col("is_part") | F.col("query_length").isNull() | (1 - nm / F.col("query_length") >= F.lit(min_align_fraction)))
    rows = rows.withColumn("exons", C.exons_of(F.col("ops"), F.col("pos"))).where(F.size("exons") > 0)
    clip = C.clipping(F.col("ops"), F.col("pos"), F.try_element_at("exons", F.lit(-1))["end"])
    aligned = C.aligned_part(F.col("ops"), F.col("strand") == "-")
    return rows.select("qname", "sample_name", "chr", "strand", "exons", F.coalesce(F.col("tags")["is"].try_cast("long"), F.lit(1).cast("long")).alias("weight"), clip.alias("clip"), aligned.alias("aligned"), "is_part")


def split_reads(reads: DataFrame, max_intron: int = 1_000_000, min_cov: int = 2) -> tuple[DataFrame, DataFrame]:
    """Chimeric reads by breakpoints, and reads whose parts make one transcript with a long intron.

    Parts are taken in the order of their place in the read. Neighbouring parts on one chromosome and strand that follow each other
    within ``max_intron`` are one part. Reads left with one part are the second result (exons joined); the others are counted by
    their breakpoints (chr, strand and position on either side), and kept from ``min_cov`` reads of a sample on.
    """
    part = F.struct(F.col("aligned")["start"].alias("at"), "chr", "strand", "exons")
    per = reads.where("is_part").groupBy("sample_name", "qname").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("weight").alias("weight")).where(F.size("parts") > 1)

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        plus = x["strand"] == "+"
        gap = F.when(plus, F.get(x["exons"], F.lit(0))["start"] - F.try_element_at(last["exons"], F.lit(-1))["end"]).otherwise(F.get(last["exons"], F.lit(0))["start"] - F.try_element_at(x["exons"], F.lit(-1))["end"])
        joins = (last["chr"] == x["chr"]) & (last["strand"] == x["strand"]) & (gap > 0) & (gap < max_intron)
        exons = F.when(plus, F.concat(last["exons"], x["exons"])).otherwise(F.concat(x["exons"], last["exons"]))
        merged = F.struct(last["at"].alias("at"), last["chr"].alias("chr"), last["strand"].alias("strand"), exons.alias("exons"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    first = F.slice("parts", 1, 1)
    per = per.withColumn("merged", F.aggregate(F.slice("parts", F.lit(2), F.size("parts") - 1), first, step))
    whole = per.where(F.size("merged") == 1).select("sample_name", "qname", F.get("merged", F.lit(0)).alias("m"), "weight").select("sample_name", "qname", "m.chr", "m.strand", "m.exons", "weight")
    leave = lambda x: F.when(x["strand"] == "+", F.try_element_at(x["exons"], F.lit(-1))["end"]).otherwise(F.get(x["exons"], F.lit(0))["start"])
    enter = lambda x: F.when(x["strand"] == "+", F.get(x["exons"], F.lit(0))["start"]).otherwise(F.try_element_at(x["exons"], F.lit(-1))["end"])
    point = lambda a, b: F.concat_ws(":", a["chr"], a["strand"], leave(a).cast("string"), b["chr"], b["strand"], enter(b).cast("string"))
    many = per.where(F.size("merged") > 1)
    points = F.zip_with(F.slice("merged", F.lit(1), F.size("merged") - 1), F.slice("merged", F.lit(2), F.size("merged") - 1), point)
    counts = many.withColumn("breakpoints", F.array_join(points, ";")).groupBy("sample_name", "breakpoints").agg(F.sum("weight").alias("n_reads"), F.max(F.size("merged")).alias("n_parts"))
    return counts.where(F.col("n_reads") >= min_cov), whole


def transcripts_of(reads: DataFrame) -> DataFrame:
    """The reads in the form that isoforms are collapsed from: transcript_id, sample_name, gene_id (a placeholder), chr, strand, exons, coverage.

    Reads of equal exons are counted first, so that what is shuffled further doesn't grow with depth.
    """
    same = reads.where("not is_part").groupBy("sample_name", "chr", "strand", "exons").agg(F.sum("weight").alias("coverage"), F.min("qname").alias("transcript_id"))
    return same.withColumn("gene_id", F.lit("reads"))


def quality_histogram(reads: DataFrame, qualities: str, error_bins: list[float], length_bins: list[int]) -> DataFrame:
    """error_bin, length_bin, n of reads by expected error rate (in per cent) and length; a bin is the first limit above the value.

    Values at or beyond the last limit are in a bin after it; reads without qualities aren't counted.
    """

    def first_above(value, limits):
        out = F.lit(len(limits))
        for i in reversed(range(len(limits))):
            out = F.when(value < limits[i], i).otherwise(out)
        return out

    rate = C.error_rate(F.col(qualities)) * 100
    rows = reads.where(F.size(qualities) > 0).select(first_above(rate, error_bins).alias("error_bin"), first_above(F.size(qualities), length_bins).alias("length_bin"))
    return rows.groupBy("error_bin", "length_bin").agg(F.count(F.lit(1)).alias("n"))
