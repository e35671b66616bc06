"""Reference annotation from GTF and GFF3 text: genes and transcripts with exon chains and coding regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exons up to this length are listed with their gene.
SHORT_EXON = 25
COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Feature lines with 0-based starts; comments and lines without nine columns are left out."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).where("value not like '#%'").select(parts.alias("c")).where(F.size("c") == len(COLUMNS))
    cols = {n: F.get("c", F.lit(i)) for i, n in enumerate(COLUMNS)}
    return rows.select(*[v.alias(n) for n, v in cols.items() if n not in ("start", "end")], (cols["start"].try_cast("long") - 1).alias("start"), cols["end"].try_cast("long").alias("end"))


def gtf_attributes(text: Column) -> Column:
    """map of ``key "value";`` pairs; of a key that is repeated the last value."""
    keys = F.regexp_extract_all(text, F.lit(r'(\w+) +(?:"[^"]*"|[^;"]+)'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'\w+ +"?([^";]*)"?'), F.lit(1))
    return _last_wins(F.arrays_zip(keys.alias("key"), values.alias("value")))


def gff_attributes(text: Column) -> Column:
    """map of ``key=value`` pairs parted by semicolons."""
    pairs = F.filter(F.split(text, ";"), lambda x: x.contains("="))
    return _last_wins(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.substring(x, F.locate("=", x) + 1, F.length(x)).alias("value"))))


def _last_wins(pairs: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def read_gtf(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Genes and transcripts of a GTF file; genes without a line of their own are inferred from their exons."""
    rows = _lines(spark, path).withColumn("a", gtf_attributes(F.col("attributes")))
    if chromosomes:
        rows = rows.where(F.col("seqid").isin(chromosomes))
    rows = rows.withColumns({"gene_id": F.col("a")["gene_id"], "transcript_id": F.col("a")["transcript_id"], "gene_name": F.coalesce(F.col("a")["gene_name"], F.col("a")["Name"], F.col("a")["name"])})
    return _assemble(rows.where("gene_id is not null"))


def read_gff3(spark: SparkSession, path: str, chromosomes: list[str] | None = None, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Genes and transcripts of a GFF3 file; ``aliases`` renames sequences, features refer to their parents by id."""
    rows = _lines(spark, path).withColumn("a", gff_attributes(F.col("attributes")))
    if aliases:
        names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        rows = rows.withColumn("seqid", F.coalesce(names[F.col("seqid")], "seqid"))
    if chromosomes:
        rows = rows.where(F.col("seqid").isin(chromosomes))
    ident, parent = F.col("a")["ID"], F.col("a")["Parent"]
    name = F.coalesce(F.col("a")["gene_name"], F.col("a")["Name"], F.col("a")["name"])
    is_gene = (F.col("type") == "gene") | (parent.isNull() & ident.startswith("gene"))
    is_tr = ~is_gene & ident.isNotNull() & parent.isNotNull() & ((F.col("type") == "transcript") | F.col("type").endswith("RNA") | parent.startswith("gene"))
    genes = rows.where(is_gene).withColumns({"type": F.lit("gene"), "gene_id": F.coalesce(F.col("a")["gene_id"], ident), "key": ident, "transcript_id": F.lit(None).cast("string"), "gene_name": name})
    trs = rows.where(is_tr).withColumns({"type": F.lit("transcript"), "transcript_id": ident, "gene_name": F.lit(None).cast("string")}).withColumn("gene_key", parent)
    gene_of = genes.select(F.col("key").alias("gene_key"), "gene_id")
    trs = trs.join(gene_of, "gene_key", "left").withColumn("gene_id", F.coalesce("gene_id", "gene_key"))
    of_tr = trs.select(F.col("transcript_id").alias("tr_key"), F.col("gene_id").alias("tr_gene"))
    parts = rows.where(F.col("type").isin("exon", "start_codon", "stop_codon")).withColumn("tr_key", F.explode(F.split(parent, ",")))
    parts = parts.join(of_tr, "tr_key").withColumns({"transcript_id": F.col("tr_key"), "gene_id": F.col("tr_gene"), "gene_name": F.lit(None).cast("string")})
    cols = ["type", "seqid", "start", "end", "strand", "gene_id", "transcript_id", "gene_name", "a"]
    return _assemble(genes.select(cols).unionByName(trs.select(cols)).unionByName(parts.select(cols)))


def read_reference(spark: SparkSession, path: str, file_format: str = "auto", **options) -> tuple[DataFrame, DataFrame]:
    """Genes and transcripts of a reference file; ``auto`` goes by the ending before ``.gz``: gtf, gff or gff3."""
    kind = path.lower().removesuffix(".gz").rsplit(".", 1)[-1] if file_format == "auto" else file_format.lower()
    readers = {"gtf": read_gtf, "gff": read_gff3, "gff3": read_gff3}
    if kind not in readers:
        raise ValueError(f"no reader for {kind!r}; known are {', '.join(readers)}")
    return readers[kind](spark, path, **options)


def _assemble(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = rows.where("type in ('gene', 'transcript', 'exon', 'start_codon', 'stop_codon')")
    of = lambda t, f, *c: f(F.when(F.col("type") == t, F.struct(*c) if len(c) > 1 else F.col(c[0])))
    low, high = lambda t: F.coalesce(of(t, F.min, "start"), F.min("start")), lambda t: F.coalesce(of(t, F.max, "end"), F.max("end"))
    per_tr = known.where("transcript_id is not null").groupBy("gene_id", "transcript_id").agg(
        F.first("seqid").alias("chr"), F.first("strand").alias("strand"), low("transcript").alias("lo"), high("transcript").alias("hi"),
        F.sort_array(F.collect_set(F.when(F.col("type") == "exon", F.struct("start", "end")))).alias("exons"),
        of("start_codon", F.min, "start").alias("init_low"), of("start_codon", F.max, "end").alias("init_high"), of("stop_codon", F.min, "start").alias("stop_low"), of("stop_codon", F.max, "end").alias("stop_high"),
    )
    whole = F.array(F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")))
    minus = F.col("strand") == "-"
    cds = F.when(F.col("init_low").isNotNull() & F.col("stop_low").isNotNull(), F.when(minus, F.struct(F.col("stop_low").alias("start"), F.col("init_high").alias("end"))).otherwise(F.struct(F.col("init_low").alias("start"), F.col("stop_high").alias("end"))))
    trs = per_tr.select("gene_id", "transcript_id", "chr", "strand", F.when(F.size("exons") == 0, whole).otherwise(F.col("exons")).alias("exons"), cds.alias("cds"))
    short = F.filter(F.array_distinct(F.flatten(F.collect_list("exons"))), lambda e: e["end"] - e["start"] <= SHORT_EXON)
    by_gene = trs.groupBy("gene_id").agg(F.sort_array(short).alias("short_exons"), F.count(F.lit(1)).alias("n_transcripts"))
    genes = known.groupBy("gene_id").agg(F.first("seqid").alias("chr"), F.first("strand").alias("strand"), low("gene").alias("start"), high("gene").alias("end"), F.max("gene_name").alias("gene_name"))
    genes = genes.join(by_gene, "gene_id", "left")
    # a gene without transcripts gets one that spans it
    bare = genes.where("n_transcripts is null").select("gene_id", F.col("gene_id").alias("transcript_id"), "chr", "strand", F.array(F.struct("start", "end")).alias("exons"), F.lit(None).cast(trs.schema["cds"].dataType).alias("cds"))
    genes = genes.withColumns({"n_transcripts": F.coalesce("n_transcripts", F.lit(1)), "gene_name": F.coalesce("gene_name", "gene_id")})
    return genes, trs.unionByName(bare)


def skipped_features(spark: SparkSession, path: str) -> DataFrame:
    """type, n of the features that the readers pass over."""
    return _lines(spark, path).where("type not in ('gene', 'transcript', 'exon', 'start_codon', 'stop_codon')").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
