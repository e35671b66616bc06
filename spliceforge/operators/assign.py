"""Assignment of transcripts to genes, novel genes, and loci of neighbouring genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.functions.intervals import exonic_length, introns
from spliceforge.operators.intervals import overlap_join, period_bounds
from spliceforge.operators.ranks import row_numbers
from spliceforge.session import materialize


#: Bases of a stretch of the genome in which transcripts meet genes.
TILE = 20_000


def _ref_exons(genes: DataFrame) -> DataFrame:
    """gene_id, is_annotated, chr, strand, start, end, opens and closes (the exon is its chain's first or last), no row twice."""
    at = genes.select("gene_id", "is_annotated", "chr", "strand", F.size("exons").alias("k"), F.posexplode("exons").alias("i", "x"))
    return at.select("gene_id", "is_annotated", "chr", "strand", "x.start", "x.end", (F.col("i") == 0).alias("opens"), (F.col("i") == F.col("k") - 1).alias("closes")).distinct()


def _in_tiles(transcripts: DataFrame) -> DataFrame:
    """transcript_id, chr, strand, tile, lo and hi (the transcript's bounds), exons: a row for each tile in which the transcript has exons, with those."""
    first, last = lambda x: F.floor(x["start"] / TILE), lambda x: F.floor((x["end"] - 1) / TILE)
    tiles = F.array_distinct(F.flatten(F.transform("exons", lambda x: F.sequence(first(x), last(x)))))
    rows = transcripts.select("transcript_id", "chr", "strand", "exons", F.get("exons", F.lit(0))["start"].alias("lo"), F.try_element_at("exons", F.lit(-1))["end"].alias("hi"), F.explode(tiles).alias("tile"))
    return rows.withColumn("exons", F.filter("exons", lambda x: (first(x) <= F.col("tile")) & (last(x) >= F.col("tile"))))


def _gene_tiles(ref: DataFrame) -> DataFrame:
    """gene_id, is_annotated, chr, strand, tile, the bounds of the union of the gene's exons within the tile (opens, closes), and its donors and acceptors there.
    A site belongs to the tile of its exon's base."""
    rows = ref.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE))))
    low, high = F.col("tile") * TILE, (F.col("tile") + 1) * TILE
    sorted_list = lambda c: F.sort_array(F.collect_list(c))
    lists = rows.groupBy("gene_id", "is_annotated", "chr", "strand", "tile").agg(
        sorted_list(F.greatest("start", low)).alias("s"), sorted_list(F.least("end", high)).alias("e"),
        F.collect_set(F.when(~F.col("closes") & (F.col("end") <= high), F.col("end"))).alias("donors"), F.collect_set(F.when(~F.col("opens") & (F.col("start") >= low), F.col("start"))).alias("acceptors"),
    )
    opens, closes = period_bounds(F.col("s"), F.col("e"))
    return lists.select("gene_id", "is_annotated", "chr", "strand", "tile", F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("union"), "donors", "acceptors")


def _shared_bases(a: Column, b: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Bases that two chains share, if given within [low, high) only."""
    start, end = (lambda x: x["start"]) if low is None else (lambda x: F.greatest(x["start"], low)), (lambda x: x["end"]) if high is None else (lambda x: F.least(x["end"], high))
    part = lambda x, y: F.greatest(F.least(end(x), y["end"]) - F.greatest(start(x), y["start"]), F.lit(0).cast("long"))
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.aggregate(b, F.lit(0).cast("long"), lambda m, y: m + part(x, y)))


def _met_genes(transcripts: DataFrame, ref: DataFrame) -> DataFrame:
    """transcript_id, chr, strand, start, length, t_size, and genes: array<struct<gene_id, is_annotated, n_bases, n_sites>> of those it shares bases with.

    Both sides meet tile by tile, where a gene is one row, however many chains it has.
    """
    tile = F.col("tile")
    donors = F.transform(F.filter("exons", lambda x: (F.floor((x["end"] - 1) / TILE) == tile) & (x["end"] < F.col("hi"))), lambda x: x["end"])
    acceptors = F.transform(F.filter("exons", lambda x: (F.floor(x["start"] / TILE) == tile) & (x["start"] > F.col("lo"))), lambda x: x["start"])
    met = _in_tiles(transcripts).join(_gene_tiles(ref), ["chr", "strand", "tile"])
    met = met.select("transcript_id", "gene_id", "is_annotated", _shared_bases(F.col("exons"), F.col("union"), tile * TILE, (tile + 1) * TILE).alias("b"), (F.size(F.array_intersect(donors, "donors")) + F.size(F.array_intersect(acceptors, "acceptors"))).alias("k"))
    sums = met.where("b > 0").repartition("transcript_id").groupBy("transcript_id", "gene_id", "is_annotated").agg(F.sum("b").alias("n_bases"), F.sum("k").alias("n_sites"))
    lists = sums.groupBy("transcript_id").agg(F.collect_list(F.struct("gene_id", "is_annotated", "n_bases", "n_sites")).alias("genes"))
    own = transcripts.select("transcript_id", "chr", "strand", F.get("exons", F.lit(0))["start"].alias("start"), exonic_length(F.col("exons")).alias("length"), F.size("exons").alias("t_size"))
    return lists.join(own, "transcript_id")


def _chains(genes: DataFrame, of: DataFrame) -> DataFrame:
    """The different chains of the genes that ``of`` has, with h1 and h2 (128 bits of hash), g_size and g_length."""
    rows = genes.select("gene_id", "chr", "strand", F.col("exons").alias("g_exons")).join(of.select("gene_id").distinct(), "gene_id", "left_semi").distinct()
    return rows.withColumns({"h1": F.xxhash64("g_exons", F.lit(1)), "h2": F.xxhash64("g_exons", F.lit(2)), "g_size": F.size("g_exons"), "g_length": exonic_length(F.col("g_exons"))})


def _ratios(pairs: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds ratio, the greatest part of one chain's exons that are shared sites, to pairs of transcript and gene."""
    hit = ["chr", "strand", "side", "pos"]
    site = lambda c: F.explode(F.flatten(F.transform(introns(F.col(c)), lambda i: F.array(F.struct(F.lit("d").alias("side"), i["donor"].alias("pos")), F.struct(F.lit("a").alias("side"), i["acceptor"].alias("pos"))))))
    mine = transcripts.select("transcript_id", "chr", "strand", "exons").join(pairs.select("transcript_id", "gene_id"), "transcript_id").select("transcript_id", "gene_id", "chr", "strand", site("exons").alias("s")).select("transcript_id", "gene_id", "chr", "strand", "s.*").distinct()
    theirs = _chains(genes, pairs).select("gene_id", "chr", "strand", "h1", "h2", "g_size", site("g_exons").alias("s")).select("gene_id", "chr", "strand", "h1", "h2", "g_size", "s.*").distinct()
    n = mine.join(theirs, ["gene_id", *hit]).groupBy("transcript_id", "gene_id", "h1", "h2", "g_size").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(n.groupBy("transcript_id", "gene_id").agg(F.max(F.col("n") / F.col("g_size")).alias("ratio")), ["transcript_id", "gene_id"], "left")


def _outermost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that lie in no other of their entity: with distinct rows by start, those that end beyond all before."""
    w = Window.partitionBy(*keys).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__reach", F.max("end").over(w)).where("__reach is null or end > __reach").drop("__reach")


def _single_overlaps(singles: DataFrame, ref: DataFrame, genes: DataFrame) -> DataFrame:
    """Of transcripts of one exon and a gene: gene_id, chr, strand, t_start, t_end, single (the most bases that a single exon of the gene shares),
    most (that any of its exons shares) and holds (the transcript holds a whole chain of the gene).

    Only a gene's outermost exons, and its chains that hold no other, can decide this, which leaves few of a gene's many.
    """
    place = ["gene_id", "chr", "strand"]
    ref = ref.where("is_annotated").select(*place, "start", "end", (F.col("opens") & F.col("closes")).alias("lone"))
    of = lambda rows, kind: _outermost(rows.select(*place, "start", "end").distinct(), place).select(*place, F.lit(kind).alias("kind"), F.col("start").alias("x_start"), F.col("end").alias("x_end"), F.col("end").alias("x_to"))
    bounds = genes.where("is_annotated").select(*place, F.get("exons", F.lit(0))["start"].alias("start"), F.try_element_at("exons", F.lit(-1))["end"].alias("end"))
    w = Window.partitionBy(*place).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    least = bounds.groupBy(*place, "end").agg(F.max("start").alias("start")).withColumn("__s", F.max("start").over(w)).where("__s is null or start > __s")
    least = least.select(*place, F.lit("chain").alias("kind"), F.col("start").alias("x_start"), (F.col("start") + 1).alias("x_end"), F.col("end").alias("x_to"))
    marks = of(ref.where("lone"), "single").unionByName(of(ref, "exon")).unionByName(least)
    asked = singles.select(*place, F.col("start").alias("t_start"), (F.col("start") + F.col("length")).alias("t_end")).distinct()
    met = overlap_join(asked, marks, place, ("t_start", "t_end"), ("x_start", "x_end"))
    shared = F.least("t_end", "x_end") - F.greatest("t_start", "x_start")
    top = lambda kind: F.max(F.when(F.col("kind") == kind, shared))
    return met.groupBy(*place, "t_start", "t_end").agg(top("single").alias("single"), top("exon").alias("most"), F.max((F.col("kind") == "chain") & (F.col("x_start") >= F.col("t_start")) & (F.col("x_to") <= F.col("t_end"))).alias("holds"))


def _parts(pairs: DataFrame, transcripts: DataFrame, genes: DataFrame, min_exon_coverage: float) -> DataFrame:
    """transcript_id, gene_id, part: the greatest part that one chain of the gene shares of the shorter one's bases, where it reaches the limit.

    A chain can only reach it if the bases of the gene do, so all others are left out before they meet.
    """
    mine = transcripts.select("transcript_id", "chr", "strand", "exons").join(pairs.select("transcript_id", "gene_id", "length", "n_bases"), "transcript_id")
    ends = lambda c: (F.get(c, F.lit(0))["start"], F.try_element_at(c, F.lit(-1))["end"])
    (a, b), (c, d) = ends("exons"), ends("g_exons")
    shorter = F.least("length", "g_length")
    met = mine.join(_chains(genes, pairs), ["gene_id", "chr", "strand"]).where((shorter * F.lit(min_exon_coverage) <= F.col("n_bases") + 1) & (a < d) & (c < b))
    return met.groupBy("transcript_id", "gene_id").agg(F.max(_shared_bases(F.col("exons"), F.col("g_exons")) / shorter).alias("part"))


def best_genes(transcripts: DataFrame, genes: DataFrame, min_exon_coverage: float = 0.25) -> DataFrame:
    """transcript_id, gene_id, step, n_sites, n_bases of the gene each transcript fits best.

    ``transcripts`` (written): transcript_id (unique), chr, strand, exons. ``genes``: gene_id, chr, strand, exons (a row a chain) and, if there, is_annotated
    (else all are). The first step that gives a gene counts: 1 an annotated gene by shared splice sites, 2 a novel one by them (ties by
    the greatest part of a chain's sites to its exons); 3 an annotated gene by exonic bases, of which it needs ``min_exon_coverage``
    of the transcript's (for single exons: the bases of one of its single exons); 4 an annotated gene of which some
    chain has that part of the shorter one's bases; 5 a novel gene by exonic bases. Ties go to more bases, then to
    the smaller gene_id. Transcripts without such a gene give no row.

    Transcripts meet a gene's chains one by one only where the outcome needs it: for ties in shared sites, and in step 4 where neither
    the gene's outermost exons nor a chain within the transcript settle it.
    """
    known = genes if "is_annotated" in genes.columns else genes.withColumn("is_annotated", F.lit(True))
    ref = materialize(_ref_exons(known), "reference-exons")
    met = _met_genes(transcripts, ref)
    by_site = F.filter("genes", lambda g: g["n_sites"] > 0)
    known_site = F.filter("genes", lambda g: (g["n_sites"] > 0) & g["is_annotated"])
    step = F.when(F.size("known_site") > 0, 1).when(F.size("by_site") > 0, 2)
    met = met.withColumns({"by_site": by_site, "known_site": known_site}).withColumn("step", step)
    met = met.withColumn("genes", F.when(F.col("step") == 1, F.col("known_site")).when(F.col("step") == 2, F.col("by_site")).otherwise(F.col("genes"))).drop("by_site", "known_site")
    met = met.withColumn("top", F.array_max(F.transform("genes", lambda g: g["n_sites"]))).withColumn("genes", F.filter("genes", lambda g: g["n_sites"] == F.col("top"))).drop("top")
    met = materialize(met, "met-genes")
    result = ["transcript_id", "gene_id", "step", "n_sites", "n_bases"]
    each = lambda rows: rows.select("transcript_id", "chr", "strand", "start", "length", "t_size", "step", F.inline("genes"))
    out = each(met.where("step is not null and size(genes) = 1")).select(result)
    ties = each(met.where("step is not null and size(genes) > 1"))
    if not ties.isEmpty():
        rows = _ratios(ties, transcripts, known)
        out = out.unionByName(_first(rows, F.struct(-F.col("ratio"), -F.col("n_bases"), F.col("gene_id"))))
    rest = each(met.where("step is null"))
    if rest.isEmpty():
        return out
    place = ["gene_id", "chr", "strand"]
    lone = _single_overlaps(rest.where("is_annotated and t_size = 1"), ref, known)
    rest = rest.withColumns({"t_start": F.col("start"), "t_end": F.when(F.col("t_size") == 1, F.col("start") + F.col("length"))}).join(lone, [*place, "t_start", "t_end"], "left").drop("t_start", "t_end")
    least, annotated = F.col("length") * F.lit(min_exon_coverage), F.col("is_annotated")
    whole = F.when(F.col("t_size") > 1, F.col("n_bases")).otherwise(F.coalesce("single", F.lit(0).cast("long")))
    rest = rest.withColumns({"whole": whole, "third": annotated & (whole >= least)})
    w = Window.partitionBy("transcript_id")
    rest = materialize(rest.withColumns({"some_third": F.max("third").over(w), "n_annotated": F.sum(annotated.cast("int")).over(w)}), "genes-by-bases")
    out = out.unionByName(_first(rest.where("third").withColumn("step", F.lit(3)), F.struct(-F.col("whole"), -F.col("n_bases"), F.col("gene_id"))))
    left = rest.where("not some_third")
    full = F.coalesce((F.col("most") == F.col("length")) | F.col("holds"), F.lit(False))
    enough = full | ((F.col("n_annotated") == 1) & F.coalesce(F.col("most") >= least, F.lit(False)))
    part = left.where(annotated & enough).withColumn("part", F.lit(1.0))
    exact = materialize(left.where(annotated & ~enough), "genes-by-chain")
    if not exact.isEmpty():
        part = part.unionByName(exact.join(_parts(exact, transcripts, known, min_exon_coverage), ["transcript_id", "gene_id"]).where(F.col("part") >= F.lit(min_exon_coverage)).select(part.columns))
    fifth = left.where(~annotated & (F.col("n_bases") >= least)).withColumn("part", F.lit(None).cast("double"))
    last = part.withColumn("step", F.lit(4)).unionByName(fifth.withColumn("step", F.lit(5)))
    return out.unionByName(_first(last, F.struct("step", -F.col("part"), -F.col("n_bases"), F.col("gene_id"))))


def _first(rows: DataFrame, rank: Column) -> DataFrame:
    return rows.groupBy("transcript_id").agg(F.min_by(F.struct("gene_id", "step", "n_sites", "n_bases"), rank).alias("b")).select("transcript_id", "b.*")


def novel_types(transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """transcript_id, novel_type of transcripts without a gene: genic genomic, intronic, antisense or intergenic.

    On the strand of a gene: genic genomic if an exon overlaps one of the gene, else intronic; only genes of the other
    strand: antisense. ``genes``: gene_id, chr, strand, exons.
    """
    span = lambda df: df.withColumns({"lo": F.get("exons", F.lit(0))["start"], "hi": F.try_element_at("exons", F.lit(-1))["end"]})
    t = span(transcripts).select("transcript_id", "chr", F.col("strand").alias("t_strand"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    g = span(genes).groupBy("gene_id", "chr", F.col("strand").alias("g_strand")).agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"))
    near = overlap_join(t, g, ["chr"], ("t_lo", "t_hi"), ("g_lo", "g_hi")).groupBy("transcript_id").agg(F.max((F.col("t_strand") == F.col("g_strand")).cast("int")).alias("same"))
    t_exons = transcripts.select("transcript_id", "chr", "strand", F.inline("exons")).withColumnsRenamed({"start": "t_start", "end": "t_end"})
    g_exons = genes.select("chr", "strand", F.inline("exons")).distinct()
    exonic = overlap_join(t_exons, g_exons, ["chr", "strand"], ("t_start", "t_end"), ("start", "end")).select("transcript_id").distinct().withColumn("exonic", F.lit(True))
    rows = transcripts.select("transcript_id").join(near, "transcript_id", "left").join(exonic, "transcript_id", "left")
    kind = F.when(F.col("exonic"), "genic genomic").when(F.col("same") == 1, "intronic").when(F.col("same") == 0, "antisense").otherwise("intergenic")
    return rows.select("transcript_id", kind.alias("novel_type"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, label (the least node linked to it in any number of steps) of links that were written; nodes are int64.

    Each round first ties the greater neighbours of a node, then the smaller ones, to the least it knows, which halves long paths; the
    links of a round are written. Ends after about the logarithm of the longest path, when every node is tied to its label.
    """
    edges = materialize(links.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "component-links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select("v", "m").unionByName(down.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after = materialize(small, "component-links")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    tied = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return tied.unionByName(edges.select(F.col("v").alias("node")).distinct().join(tied.select("node"), "node", "left_anti").withColumn("label", F.col("node")))


def novel_genes(transcripts: DataFrame, prefix: str = "PB_novel_", min_overlap: float = 0.5) -> DataFrame:
    """transcript_id, novel_gene: transcripts of a strand are of one gene if they share a splice site, or if the bases they share are more than
    ``min_overlap`` of those that either has; directly or through others.

    ``transcripts`` (written): transcript_id (int64), chr, strand, exons. Genes are numbered by chromosome, strand, start and least transcript. A
    site links the transcripts that have it to their least one, never in pairs; transcripts with equal exons count as one before
    bases are compared, and only those of which the shorter has more than ``min_overlap`` of the longer meet on their exons.
    """
    place = ["chr", "strand"]
    site = F.explode(F.flatten(F.transform(introns(F.col("exons")), lambda i: F.array(F.struct(F.lit("d").alias("side"), i["donor"].alias("pos")), F.struct(F.lit("a").alias("side"), i["acceptor"].alias("pos"))))))
    at = transcripts.select("transcript_id", *place, site.alias("s"))
    firsts = at.groupBy(*place, "s").agg(F.min("transcript_id").alias("b"))
    links = at.join(firsts, [*place, "s"]).select(F.col("transcript_id").alias("a"), "b")
    text = F.to_json("exons")
    same = transcripts.groupBy(*place, text.alias("text")).agg(F.min("transcript_id").alias("b"), F.min_by("exons", "transcript_id").alias("exons"))
    links = links.unionByName(transcripts.select("transcript_id", *place, text.alias("text")).join(same, [*place, "text"]).select(F.col("transcript_id").alias("a"), "b"))
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    exons = same.select("b", *place, size.alias("size"), F.inline("exons"))
    side = lambda x: exons.toDF(f"{x}", *place, f"{x}_size", f"{x}_start", f"{x}_end")
    met = overlap_join(side("a"), side("c"), place, ("a_start", "a_end"), ("c_start", "c_end")).where((F.col("a") < F.col("c")) & (F.least("a_size", "c_size") > F.greatest("a_size", "c_size") * F.lit(min_overlap)))
    shared = met.groupBy("a", "c").agg(F.sum(F.least("a_end", "c_end") - F.greatest("a_start", "c_start")).alias("n"), F.first(F.col("a_size") + F.col("c_size")).alias("both"))
    near = shared.where(F.col("n") > (F.col("both") - F.col("n")) * F.lit(min_overlap)).select("a", F.col("c").alias("b"))
    label = components(links.unionByName(near), "a", "b")
    rows = transcripts.select("transcript_id", *place, F.get("exons", F.lit(0))["start"].alias("start")).join(label.withColumnRenamed("node", "transcript_id"), "transcript_id", "left")
    rows = rows.withColumn("label", F.coalesce("label", "transcript_id"))
    numbers = row_numbers(rows.groupBy("label").agg(F.min("chr").alias("chr"), F.min("strand").alias("strand"), F.min("start").alias("start")), [], ["chr", "strand", "start", "label"], "no")
    return rows.join(numbers.select("label", "no"), "label").select("transcript_id", F.format_string(prefix + "%05d", "no").alias("novel_gene"))


def loci(genes: DataFrame, keys: list[str], start: str, end: str, max_gap: int = 300_000) -> DataFrame:
    """Adds locus_no: genes of ``keys``, by position, belong together while no gap is longer than ``max_gap``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = genes.withColumn("__new", F.coalesce((F.col(start) - reach > max_gap).cast("int"), F.lit(1)))
    return new.withColumn("locus_no", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")
