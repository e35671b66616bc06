"""Sequences, tables and metadata in other text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq (upper case) of each record; records are split at the line start ``>``, not read as whole files."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    body = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(body, r"^(\S+)", 1)
    return rows.select(name.alias("name"), F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def tiles(fasta: DataFrame, size: int = TILE, overlap: int = 64) -> DataFrame:
    """name, tile_no, tile_start, seq in overlapping tiles, for joins on (name, position div size)."""
    no = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / size).cast("int"))).alias("tile_no")
    rows = fasta.select("name", "seq", no)
    return rows.select("name", "tile_no", (F.col("tile_no") * size).alias("tile_start"), F.substring(F.col("seq"), F.col("tile_no") * size + 1, F.lit(size + overlap)).alias("seq"))


def read_coverage(spark: SparkSession, path: str, sep: str = ",", sample_columns: dict[str, str] | None = None) -> DataFrame:
    """transcript_id, sample_name, coverage (positive) of a wide table with ``<sample>_coverage`` columns.

    The id is transcript_id, or gene_id and transcript_nr joined by an underscore. ``sample_columns`` maps columns to samples.
    """
    rows = spark.read.csv(path, sep=sep, header=True)
    columns = sample_columns or {c: c.removesuffix("_coverage") for c in rows.columns if c.endswith("_coverage") and not c.endswith("_sum_coverage")}
    ident = F.col("transcript_id") if "transcript_id" in rows.columns else F.concat_ws("_", "gene_id", "transcript_nr")
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("sample_name"), F.col(f"`{c}`").try_cast("long").alias("coverage")) for c, s in columns.items()]))
    return rows.select(ident.alias("transcript_id"), each).where("coverage > 0").groupBy("transcript_id", "sample_name").agg(F.max("coverage").alias("coverage"))


def import_samples(coverage: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coverage joined to transcripts of an annotation, and the ids that the annotation lacks."""
    return coverage.join(transcripts, "transcript_id"), coverage.join(transcripts, "transcript_id", "left_anti").select("transcript_id").distinct()


def read_family_metadata(spark: SparkSession, path: str) -> DataFrame:
    """accession and a map of the ``#=GF`` fields of a Stockholm file, whose records end with ``//``."""
    rows = spark.read.option("lineSep", "\n//").text(path)
    keys = F.regexp_extract_all("value", F.lit(r"(?m)^#=GF +(\w+) +.*$"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(r"(?m)^#=GF +\w+ +(.*?)\s*$"), F.lit(1))
    first = F.aggregate(F.arrays_zip(keys.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return rows.select(first.alias("fields")).select(F.col("fields")["AC"].alias("accession"), "fields").where("accession is not null")


MATCHES = T.ArrayType(T.StructType([T.StructField("accession", T.StringType()), T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def read_domain_hits(rows: DataFrame, key: str, json: str) -> DataFrame:
    """``key``, accession, name, start, end, score of JSON lists of protein matches; text that doesn't parse gives no row."""
    return rows.select(key, F.inline(F.from_json(json, MATCHES)))


def read_hexamers(spark: SparkSession, path: str) -> DataFrame:
    """hexamer, coding, noncoding of a table parted by white space, with a header."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(c, F.lit(0)).alias("hexamer"), F.get(c, F.lit(1)).try_cast("double").alias("coding"), F.get(c, F.lit(2)).try_cast("double").alias("noncoding")).where("coding is not null")
