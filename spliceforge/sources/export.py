"""Writing of annotation, event tables and whole catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.operators.ranks import row_numbers
from spliceforge.operators.segments import exon_rows, last_nodes

EVENT_FILES = {"ES": "SE", "3AS": "A3SS", "5AS": "A5SS", "IR": "RI", "ME": "MXE"}
VERSION, VERSION_FILE = "1", "catalog_version"


def gtf_lines(isoforms: DataFrame, source: str = "spliceforge") -> DataFrame:
    """chr, start, rank, value: gene, transcript and exon lines. ``isoforms``: gene_id, chr, strand, isoform, exons, reads and, if there, novelty."""
    span = isoforms.withColumns({"lo": F.get("exons", F.lit(0))["start"], "hi": F.try_element_at("exons", F.lit(-1))["end"], "isoform": F.col("isoform").cast("string")})
    novelty = F.concat(F.lit(' novelty "'), F.col("novelty"), F.lit('";')) if "novelty" in isoforms.columns else F.lit("")

    def line(kind: str, start, end, attributes):
        return F.concat_ws("\t", "chr", F.lit(source), F.lit(kind), (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), attributes)

    gene = span.groupBy("gene_id", "chr", "strand").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gene_text = F.format_string('gene_id "%s";', "gene_id")
    tr_text = F.concat(F.format_string('gene_id "%s"; transcript_id "%s"; reads "%d";', "gene_id", "isoform", "reads"), novelty)
    exon_text = F.format_string('gene_id "%s"; transcript_id "%s"; exon_number "%d";', F.col("gene_id"), F.col("isoform"), F.col("no") + 1)
    order = lambda a, b, c: F.struct(F.col("gene_id").alias("g"), a.alias("t"), b.alias("k"), c.alias("n"))
    genes = gene.select("chr", F.col("lo").alias("start"), order(F.lit(""), F.lit(0), F.lit(0)).alias("rank"), line("gene", F.col("lo"), F.col("hi"), gene_text).alias("value"))
    trs = span.select("chr", F.col("lo").alias("start"), order(F.col("isoform"), F.lit(1), F.lit(0)).alias("rank"), line("transcript", F.col("lo"), F.col("hi"), tr_text).alias("value"))
    each = span.select("gene_id", "chr", "strand", "isoform", F.posexplode("exons").alias("no", "x"))
    exons = each.select("chr", F.col("x")["start"].alias("start"), order(F.col("isoform"), F.lit(2), F.col("no")).alias("rank"), line("exon", F.col("x")["start"], F.col("x")["end"], exon_text).alias("value"))
    return genes.unionByName(trs).unionByName(exons)


def write_gtf(isoforms: DataFrame, path: str, gzip: bool = False, source: str = "spliceforge") -> None:
    """Text parts in the order of chromosome and gene; all lines of a gene are in one part."""
    rows = gtf_lines(isoforms, source).withColumn("gene", F.col("rank")["g"])
    rows = rows.repartitionByRange("chr", "gene").sortWithinPartitions("chr", "rank")
    rows.select("value").write.text(path, compression="gzip" if gzip else "none")


def numbered_events(events: DataFrame) -> DataFrame:
    """Adds file (the event's name elsewhere) and row_id (from 1, by gene and position within each kind)."""
    names = F.create_map(*[F.lit(x) for kv in EVENT_FILES.items() for x in kv])
    rows = events.withColumn("file", names[F.col("event_type")]).where("file is not null")
    order = ["gene_id", "start", "end", "node_a", "node_b", *(c for c in ("via",) if c in events.columns)]
    return row_numbers(rows, ["file"], order, "row_id")


def write_events(events: DataFrame, folder: str) -> None:
    """One folder of tab-separated rows for each kind of event."""
    numbered_events(events).write.partitionBy("file").csv(folder, sep="\t", header=True)


EVENT_KEY = ["gene_id", "event_type", "node_a", "node_b", "via"]


def event_paths(sides: DataFrame, isoforms: DataFrame, path: DataFrame, segs: DataFrame) -> DataFrame:
    """EVENT_KEY (via -1 for none), side, isoform, reads, exons (those from A to B, cut there), flank_start and flank_end (of the whole exons that
    hold A and B), a_end, b_start. ``sides``: events isoform by isoform; ``isoforms``: isoform, gene_id, exons, reads."""
    named = sides.where(F.col("event_type").isin(list(EVENT_FILES))).withColumn("via", F.coalesce("via", F.lit(-1)))
    a = segs.select("gene_id", F.col("node").alias("node_a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = segs.select("gene_id", F.col("node").alias("node_b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    whole = exon_rows(isoforms).drop("gene_id").join(last_nodes(path).select("isoform", "exon_no", "exon_first", "exon_last"), ["isoform", "exon_no"])
    rows = named.join(a, ["gene_id", "node_a"]).join(b, ["gene_id", "node_b"]).join(whole, "isoform").where("exon_last >= node_a and exon_first <= node_b")
    low, high = F.when(F.col("exon_first") < F.col("node_a"), F.col("a_start")).otherwise(F.col("start")), F.when(F.col("exon_last") > F.col("node_b"), F.col("b_end")).otherwise(F.col("end"))
    rows = rows.groupBy(*EVENT_KEY, "side", "isoform", "a_end", "b_start").agg(F.sort_array(F.collect_list(F.struct(low.alias("start"), high.alias("end")))).alias("exons"), F.min("start").alias("flank_start"), F.max("end").alias("flank_end"))
    return rows.join(isoforms.select("isoform", "reads"), "isoform")


def event_gff_lines(paths: DataFrame, place: DataFrame) -> DataFrame:
    """event_id, no, value: gene, mRNA and exon lines of each event, an mRNA for each different exon path: A0, A1, .. of the primary side and B0,
    B1, .. of the alternative one, in the order of their exons. ``paths``: see :func:`event_paths`; ``place``: gene_id, chr, strand."""
    each = paths.select(*EVENT_KEY, "a_end", "b_start", "side", "exons").distinct().join(place, "gene_id")
    via = F.when(F.col("via") >= 0, F.concat(F.lit("_"), F.col("via").cast("string"))).otherwise("")
    ident = F.concat(F.col("gene_id"), F.lit(":"), F.col("a_end").cast("string"), F.lit("-"), F.col("b_start").cast("string"), F.lit("_"), "event_type", via)
    pick = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("exons"))))
    events = each.groupBy(ident.alias("event_id"), "event_type", "chr", "strand", "gene_id").agg(pick("primary").alias("a"), pick("alternative").alias("b"))
    head = lambda x: F.get(x, F.lit(0))["start"]
    tail = lambda x: F.try_element_at(x, F.lit(-1))["end"]

    def line(kind: str, start, end, text):
        return F.concat_ws("\t", "chr", "event_type", F.lit(kind), (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), text)

    def mrna(name: str, exons, i):
        own = F.concat(F.col("event_id"), F.lit(f".{name}"), i.cast("string"))
        inner = F.transform(exons, lambda e, j: line("exon", e["start"], e["end"], F.concat(F.lit("Parent="), own, F.lit(";ID="), own, F.lit("."), j.cast("string"))))
        return F.concat(F.array(line("mRNA", head(exons), tail(exons), F.concat(F.lit("Parent="), F.col("event_id"), F.lit(";ID="), own))), inner)

    both = F.concat("a", "b")
    gene = line("gene", F.array_min(F.transform(both, head)), F.array_max(F.transform(both, tail)), F.concat(F.lit("ID="), "event_id", F.lit(";gene_id="), "gene_id"))
    lines = F.concat(F.array(gene), F.flatten(F.transform("a", lambda x, i: mrna("A", x, i))), F.flatten(F.transform("b", lambda x, i: mrna("B", x, i))))
    return events.select("event_id", F.posexplode(lines).alias("no", "value"))


def event_layouts(paths: DataFrame) -> DataFrame:
    """file, row_id, gene_id and up to four exons (x1_start, x1_end, ..): the exons by which a splicing tool knows an event.

    SE: skipped, upstream, downstream; RI: retained, upstream, downstream; A3SS and A5SS: long, short, flanking; MXE: first, second,
    upstream, downstream (a row for each different primary exon). Up- and downstream are in genomic order. Flanks are those of
    the isoform with most reads of either side (ties: the smaller name), the alternative is the exon path with most reads (ties: the
    first). Events whose paths have another number of exons than their layout needs are left out.
    """
    top = paths.groupBy(*EVENT_KEY, "a_end", "b_start").agg(F.max_by(F.struct("flank_start", "flank_end"), F.struct(F.col("reads"), -F.col("isoform"))).alias("f"))
    side = lambda s: paths.where(F.col("side") == s).groupBy(*EVENT_KEY, "exons").agg(F.sum("reads").alias("reads"))
    best = side("alternative").groupBy(*EVENT_KEY).agg(F.min_by("exons", F.struct(-F.col("reads"), F.col("exons"))).alias("b"))
    other = side("primary").where((F.col("event_type") == "ME") & (F.size("exons") == 3)).select(*EVENT_KEY, F.get("exons", F.lit(1)).alias("second"))
    names = F.create_map(*[F.lit(x) for kv in EVENT_FILES.items() for x in kv])
    rows = top.join(best, EVENT_KEY).join(other, EVENT_KEY, "left").withColumn("file", names[F.col("event_type")])
    exon = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    up, down = exon(F.col("f.flank_start"), F.col("a_end")), exon(F.col("b_start"), F.col("f.flank_end"))
    x, n = (lambda i: exon(F.get("b", F.lit(i))["start"], F.get("b", F.lit(i))["end"])), F.size("b")
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    late = x(0)["end"] == F.col("a_end")  # the site that differs is at B
    shift = F.when(late, F.array(exon(x(1)["start"], down["end"]), down, up, none)).otherwise(F.array(exon(up["start"], x(0)["end"]), up, down, none))
    layout = (
        F.when((F.col("file") == "SE") & (n == 3), F.array(x(1), up, down, none))
        .when((F.col("file") == "RI") & (n == 1), F.array(exon(up["start"], down["end"]), up, down, none))
        .when(F.col("file").isin("A3SS", "A5SS") & (n == 2), shift)
        .when((F.col("file") == "MXE") & (n == 3) & F.col("second").isNotNull(), F.array(x(1), exon(F.col("second.start"), F.col("second.end")), up, down))
    )
    rows = rows.withColumn("x", layout).where("x is not null")
    bounds = [F.get("x", F.lit(i))[f].alias(f"x{i + 1}_{f}") for i in range(4) for f in ("start", "end")]
    flat = rows.select("file", "gene_id", *bounds)
    return row_numbers(flat, ["file"], ["gene_id", *[c for c in flat.columns if c.startswith("x")]], "row_id")


def save_catalog(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, partitioned by chr where it has one, and the version."""
    for name, df in tables.items():
        writer = df.write
        spark = df.sparkSession
        (writer.partitionBy("chr") if "chr" in df.columns else writer).parquet(f"{folder}/{name}")
    if tables:
        spark.createDataFrame([(VERSION,)], "value string").coalesce(1).write.text(f"{folder}/{VERSION_FILE}")


def load_catalog(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a catalog; one written by another version isn't read."""
    marks = [r["value"] for r in spark.read.text(f"{folder}/{VERSION_FILE}").collect()]  # one line
    if marks != [VERSION]:
        raise ValueError(f"the catalog has version {marks}, not {VERSION}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
