"""Segment graphs: the disjoint exonic pieces of a gene and each isoform's path over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.session import materialize


def exon_rows(iso: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident``, exon_no (from 1), start, end."""
    each = iso.select("gene_id", ident, F.posexplode("exons").alias("__i", "__x"))
    return each.select("gene_id", ident, (F.col("__i") + 1).alias("exon_no"), F.col("__x.start").alias("start"), F.col("__x.end").alias("end"))


def segments(exons: DataFrame) -> DataFrame:
    """gene_id, node (from 0), start, end: a sweep over the exon bounds, which are counted per position first."""
    bound = F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    at = exons.select("gene_id", bound).groupBy("gene_id", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("gene_id").orderBy("pos")
    cut = at.select("gene_id", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).alias("open")).where("open > 0")
    return cut.select("gene_id", (F.row_number().over(Window.partitionBy("gene_id").orderBy("start")) - 1).alias("node"), "start", "end")


def spans(exons: DataFrame, segs: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident``, exon_no, exon_first, exon_last (first and last node of the exon), exon_pre and exon_suc (the nodes before and behind
    it), tss, pas (first and last node in genomic order). Exon bounds are segment bounds, so both joins are equi-joins on a position."""
    first = segs.select("gene_id", F.col("start"), F.col("node").alias("exon_first"))
    last = segs.select("gene_id", F.col("end"), F.col("node").alias("exon_last"))
    w = Window.partitionBy("gene_id", ident)
    o = w.orderBy("exon_no")
    return exons.join(first, ["gene_id", "start"]).join(last, ["gene_id", "end"]).select(
        "gene_id", ident, "exon_no", "exon_first", "exon_last", F.lag("exon_last").over(o).alias("exon_pre"), F.lead("exon_first").over(o).alias("exon_suc"),
        F.min("exon_first").over(w).alias("tss"), F.max("exon_last").over(w).alias("pas"),
    )


def paths(spans: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident``, node, exon_no, exon_first, exon_last, pre, suc, tss, pas: a row for each node of each exon.

    The nodes of an exon follow each other without a gap, so nothing is joined or sorted for them; where the step to a node crosses an
    intron, the node is its exon's first. The hint keeps joins from broadcasting what was rolled out, whose size Spark takes for that of
    the spans.
    """
    node = F.col("node")
    pre, suc = F.when(node > F.col("exon_first"), node - 1).otherwise(F.col("exon_pre")), F.when(node < F.col("exon_last"), node + 1).otherwise(F.col("exon_suc"))
    each = spans.select("*", F.explode(F.sequence("exon_first", "exon_last")).alias("node"))
    return each.select("gene_id", ident, "node", "exon_no", "exon_first", "exon_last", pre.alias("pre"), suc.alias("suc"), "tss", "pas").hint("merge")


def last_nodes(path: DataFrame) -> DataFrame:
    """The rows of a path that stand for whole exons."""
    return path.where("node = exon_last")


def restore(path: DataFrame, segs: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident``, exons: the chains that the paths stand for."""
    first = segs.select("gene_id", F.col("node").alias("exon_first"), "start")
    last = segs.select("gene_id", F.col("node").alias("exon_last"), "end")
    rows = last_nodes(path).join(first, ["gene_id", "exon_first"]).join(last, ["gene_id", "exon_last"])
    return rows.groupBy("gene_id", ident).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))


def edges(path: DataFrame) -> DataFrame:
    """gene_id, node_a, node_b, spliced, n_isoforms: the direct links of the graph."""
    links = path.where("suc is not null").groupBy("gene_id", F.col("node").alias("node_a"), F.col("suc").alias("node_b"))
    return links.agg(F.max(F.col("node") == F.col("exon_last")).alias("spliced"), F.count(F.lit(1)).alias("n_isoforms"))


def _bounds(chains: DataFrame, ident: str, name: str, *more: str) -> DataFrame:
    """gene_id, ``name``, ``more``, exons, pos: start, end, start, end, ... of the chain's exons."""
    return chains.select("gene_id", F.col(ident).alias(name), *more, "exons", F.flatten(F.transform("exons", lambda x: F.array(x["start"].cast("long"), x["end"].cast("long")))).alias("pos"))


#: Of the bounds ``pos``, the inner ones of the first ``k`` introns as 128 bits of hash.
def _inner(k: Column) -> list[Column]:
    part = F.slice("pos", F.lit(2), k * 2)
    return [F.xxhash64(part, F.lit(i)).alias(f"h{i}") for i in (1, 2)]


#: Bounds of tiles in which single exons meet those that hold them.
TILE = 20_000


def containments(small: DataFrame, big: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, small, container, exon_no (of the container's exon in which the small one begins, from 1), small_exons, big_exons and, if ``big`` has it, strand: chains of
    ``small`` that are a piece of one of ``big``; of equal chains the smaller ident holds the other. Both: gene_id, ``ident``, exons (ascending, disjoint).

    A chain of several exons is a piece of another whose introns have its own as a run, and whose exons beside the run reach as far as its
    outer ones. A container therefore names each run of its introns, by a hash, and chains meet only where the whole run is equal;
    it travels once for each first intron, and runs are rolled out behind that. Single exons meet within tiles.
    """
    a = _bounds(small, ident, "small").where(F.size("pos") > 2)
    key = ["gene_id", "donor", "acceptor"]
    a = a.select("gene_id", F.get("pos", F.lit(1)).alias("donor"), F.get("pos", F.lit(2)).alias("acceptor"), "small", F.get("pos", F.lit(0)).alias("s"), F.try_element_at("pos", F.lit(-1)).alias("e"), F.size("exons").alias("small_exons"), *_inner(F.size("exons") - 1))
    more = [c for c in big.columns if c == "strand"]
    b = _bounds(big, ident, "container", *more).withColumn("big_exons", F.size("exons"))
    runs = b.where("big_exons > 1").select("gene_id", "container", *more, "big_exons", F.col("pos").alias("all"), F.explode(F.sequence(F.lit(1), F.col("big_exons") - 1)).alias("exon_no"))
    runs = runs.withColumn("pos", F.slice("all", F.col("exon_no") * 2 - 1, (F.col("big_exons") - F.col("exon_no") + 1) * 2)).drop("all")
    runs = runs.withColumns({"donor": F.get("pos", F.lit(1)), "acceptor": F.get("pos", F.lit(2))}).repartition(*key)
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("big_exons") - F.col("exon_no"))))
    runs = runs.select(*key, "container", *more, "exon_no", "big_exons", F.get("pos", F.lit(0)).alias("from"), F.get("pos", F.col("k") * 2 + 1).alias("to"), *_inner(F.col("k")))
    many = runs.join(a.repartition(*key).hint("shuffle_hash"), [*key, "h1", "h2"]).where("from <= s and e <= to")
    columns = ["gene_id", "small", "container", "exon_no", "small_exons", "big_exons", *more]
    equal = (F.col("small_exons") == F.col("big_exons")) & (F.col("from") == F.col("s")) & (F.col("to") == F.col("e"))
    many = many.where((F.col("small") != F.col("container")) & (~equal | (F.col("container") < F.col("small"))))
    one = _bounds(small, ident, "small").where(F.size("pos") == 2).select("gene_id", "small", F.get("pos", F.lit(0)).alias("s"), F.get("pos", F.lit(1)).alias("e"), F.lit(1).alias("small_exons")).withColumn("tile", F.floor(F.col("s") / TILE))
    each = b.select("gene_id", "container", *more, "big_exons", F.posexplode("exons").alias("i", "x")).select("gene_id", "container", *more, "big_exons", (F.col("i") + 1).alias("exon_no"), F.col("x.start").cast("long").alias("from"), F.col("x.end").cast("long").alias("to"))
    each = each.withColumn("tile", F.explode(F.sequence(F.floor(F.col("from") / TILE), F.floor(F.col("to") / TILE))))
    single = each.join(one, ["gene_id", "tile"]).where("from <= s and e <= to").where((F.col("small") != F.col("container")) & (~equal | (F.col("container") < F.col("small"))))
    return many.select(columns).unionByName(single.select(columns))


def contained(chains: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident`` of the chains that are a piece of another's of their gene."""
    return containments(chains, chains, ident).select("gene_id", F.col("small").alias(ident)).distinct()


def chain_fragments(chains: DataFrame, ident: str = "isoform") -> DataFrame:
    """gene_id, ``ident``, container, missing_5, missing_3: chains (gene_id, ``ident``, strand, exons; written) that are a piece of another's.

    A container that is itself contained isn't given; of equal chains the smaller ident is the container. missing_5 and
    missing_3 count the container's introns beyond the fragment. What is contained is found first and written, so that only the other
    chains name their runs for the list, and the list itself isn't moved.
    """
    key = ["gene_id", ident]
    chains = chains.select(*key, "strand", "exons")
    inner = materialize(contained(chains.drop("strand"), ident), "contained-chains")
    kept = containments(chains.join(inner, key, "left_semi"), chains.join(inner, key, "left_anti"), ident)
    low, high = F.col("exon_no") - 1, F.col("big_exons") - F.col("small_exons") - F.col("exon_no") + 1
    minus = F.col("strand") == "-"
    return kept.select("gene_id", F.col("small").alias(ident), "container", F.when(minus, high).otherwise(low).alias("missing_5"), F.when(minus, low).otherwise(high).alias("missing_3"))


def fragments(path: DataFrame, strand: DataFrame, ident: str = "isoform") -> DataFrame:
    """:func:`chain_fragments` of paths, for which gene_id, strand are given: isoforms whose path is a piece of another's."""
    whole = last_nodes(path).groupBy("gene_id", ident).agg(F.sort_array(F.collect_list(F.struct(F.col("exon_first").alias("start"), F.col("exon_last").alias("end")))).alias("exons"))
    return chain_fragments(materialize(whole.join(strand, "gene_id"), "path-chains"), ident)
