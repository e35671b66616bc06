"""Alternative splicing events: pairs of nodes that isoforms of a gene connect in different ways.

An event has a primary side (the more direct way) and an alternative side. Rows name one isoform each, so that coverage is
joined and summed without collecting sets (an isoform's name is its own over all genes): gene_id, event_type, node_a, node_b, side (``primary`` or ``alternative``), isoform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceforge.operators.segments import last_nodes
from spliceforge.session import materialize

EVENT = ["gene_id", "event_type", "node_a", "node_b"]
#: The key where ME events are among them: several may have one A and B.
KEY = [*EVENT, "via"]
#: By (alternative leaves A without a gap, alternative reaches B without a gap), on the + strand.
PLUS_TYPES = {(0, 0): "ES", (0, 1): "3AS", (1, 0): "5AS", (1, 1): "IR"}
SWAPPED = {"3AS": "5AS", "5AS": "3AS", "TSS": "PAS", "PAS": "TSS"}


def _by_strand(plus: F.Column) -> F.Column:
    swap = plus
    for a, b in SWAPPED.items():
        swap = F.when(plus == a, b).otherwise(swap)
    return F.when(F.col("strand") == "-", swap).otherwise(plus)


def _direct(path: DataFrame) -> DataFrame:
    """gene_id, node_a, node_b, isoform: the introns with at least one node between their ends."""
    return last_nodes(path).where("suc > node + 1").select("gene_id", F.col("node").alias("node_a"), F.col("suc").alias("node_b"), "isoform")


def _alternatives(path: DataFrame, strand: DataFrame) -> DataFrame:
    pairs = _direct(path).select("gene_id", "node_a", "node_b").distinct()
    left = path.select("gene_id", F.col("node").alias("node_a"), "isoform", F.col("suc").alias("suc_a"), (F.col("node") < F.col("exon_last")).cast("int").alias("out_joined"), "pas")
    right = path.select(F.col("node").alias("node_b"), "isoform", (F.col("node") > F.col("exon_first")).cast("int").alias("in_joined"))
    kind = F.lit(None).cast("string")
    for (a, b), name in PLUS_TYPES.items():
        kind = F.when((F.col("out_joined") == a) & (F.col("in_joined") == b), name).otherwise(kind)
    alt = pairs.join(strand, "gene_id").join(left, ["gene_id", "node_a"]).where("suc_a < node_b and pas > node_b").join(right, ["isoform", "node_b"])
    return alt.select("gene_id", _by_strand(kind).alias("event_type"), "node_a", "node_b", F.lit("alternative").alias("side"), "isoform")


def simple_events(path: DataFrame, strand: DataFrame) -> DataFrame:
    """ES, 3AS, 5AS and IR: A and B are linked directly by the primary isoforms; the alternatives leave A for a nearer node and
    reach B, which isn't their last. Joins are on (gene, A) and (isoform, B); isoforms, whose names differ over all genes, meet only
    through a direct link. Where only totals are wanted, :func:`simple_event_totals` doesn't list the isoforms."""
    alt = materialize(_alternatives(path, strand), "event-alternatives")  # the primary side is found from it
    primary = alt.select(*EVENT).distinct().join(_direct(path), ["gene_id", "node_a", "node_b"])
    return alt.unionByName(primary.select(*EVENT, F.lit("primary").alias("side"), "isoform"))


def simple_event_totals(path: DataFrame, strand: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`event_totals` gives for the simple events, without a list of isoforms: those of the alternative side are summed as they
    are found, those of the primary side once for each direct link, whatever events it has."""
    mine = reads.select("isoform", *by, "reads")
    sums = lambda side: (F.sum("reads").alias(f"{side}_reads"), F.count(F.lit(1)).alias(f"n_{side}"))
    alt = materialize(_alternatives(path, strand).drop("side").join(mine, "isoform").groupBy(*EVENT, *by).agg(*sums("alternative")), "alternative-totals")
    link = _direct(path).join(mine, "isoform").groupBy("gene_id", "node_a", "node_b", *by).agg(*sums("primary"))
    primary = alt.select(*EVENT).distinct().join(link, ["gene_id", "node_a", "node_b"])
    none = F.lit(0).cast("long")
    parts = alt.withColumns({"primary_reads": none, "n_primary": none}).unionByName(primary.withColumns({"alternative_reads": none, "n_alternative": none}))
    return parts.groupBy(*EVENT, *by).agg(*[F.sum(c).alias(c) for c in ("primary_reads", "alternative_reads", "n_primary", "n_alternative")])


def exclusive_events(path: DataFrame) -> DataFrame:
    """ME: from A, alternatives go by a nearer exon and primaries by one at or beyond B, and all meet again in C, the first node of the
    exon after that. An alternative counts for the nearest B that has such a C; node_b is C."""
    exon = last_nodes(path).select("gene_id", "isoform", "exon_no", F.col("exon_first").alias("first"), F.col("exon_last").alias("last"))
    after = exon.select("gene_id", "isoform", (F.col("exon_no") - 2).alias("exon_no"), F.col("first").alias("node_c"))
    nxt = exon.select("gene_id", "isoform", (F.col("exon_no") - 1).alias("exon_no"), F.col("first").alias("inner_first"), F.col("last").alias("inner_last"))
    hop = exon.select("gene_id", "isoform", "exon_no", F.col("last").alias("node_a")).join(nxt, ["gene_id", "isoform", "exon_no"]).join(after, ["gene_id", "isoform", "exon_no"]).drop("exon_no")
    # per A, B, C: the isoforms that go A, exon at B, C
    by_b = hop.select("gene_id", "node_a", F.col("inner_first").alias("b"), "node_c").distinct()
    alt = hop.select("gene_id", "node_a", "node_c", "isoform", F.col("inner_last").alias("alt_last"))
    met = alt.join(by_b, ["gene_id", "node_a", "node_c"]).where("b > alt_last")
    nearest = met.groupBy("gene_id", "node_a", "node_c", "isoform").agg(F.min("b").alias("b"))
    fresh = nearest.select("gene_id", "node_a", "node_c", "b").distinct()
    alts = met.join(fresh, ["gene_id", "node_a", "node_c", "b"])
    prims = fresh.join(hop.select("gene_id", "node_a", "node_c", "isoform", F.col("inner_first").alias("mine")), ["gene_id", "node_a", "node_c"]).where("mine >= b")
    name = F.lit("ME").alias("event_type")
    pick = lambda rows, side: rows.select("gene_id", name, "node_a", F.col("node_c").alias("node_b"), F.lit(side).alias("side"), "isoform", F.col("b").alias("via"))
    return pick(alts, "alternative").unionByName(pick(prims, "primary"))


def end_events(path: DataFrame, strand: DataFrame) -> DataFrame:
    """TSS and PAS: isoforms that share the last node of the first exon (the first of the last exon) are the alternative, all others
    of the gene that reach beyond it the primary; nodes run over the shared exon. Isoforms of one exon have no such end.

    Only the alternative side is listed isoform by isoform; the primary side is every other isoform with pas > node (tss < node),
    which :func:`end_event_totals` sums from running totals instead of pairing isoforms with events.
    """
    ends = _ends(path)
    tss = ends.where("first_last != pas").groupBy("gene_id", F.col("first_last").alias("n")).agg(F.min("tss").alias("outer"), F.collect_list("isoform").alias("iso"))
    pas = ends.where("first_last != pas").groupBy("gene_id", F.col("last_first").alias("n")).agg(F.max("pas").alias("outer"), F.collect_list("isoform").alias("iso"))
    tss = tss.select("gene_id", F.lit("TSS").alias("t"), F.col("outer").alias("node_a"), F.col("n").alias("node_b"), F.explode("iso").alias("isoform"))
    pas = pas.select("gene_id", F.lit("PAS").alias("t"), F.col("n").alias("node_a"), F.col("outer").alias("node_b"), F.explode("iso").alias("isoform"))
    return tss.unionByName(pas).join(strand, "gene_id").select("gene_id", _by_strand(F.col("t")).alias("event_type"), "node_a", "node_b", F.lit("alternative").alias("side"), "isoform")


def _ends(path: DataFrame) -> DataFrame:
    """gene_id, isoform, tss, pas, and the last node of the first and the first node of the last exon."""
    return last_nodes(path).groupBy("gene_id", "isoform").agg(F.min("tss").alias("tss"), F.max("pas").alias("pas"), F.min_by("exon_last", "node").alias("first_last"), F.max_by("exon_first", "node").alias("last_first"))


def end_event_totals(path: DataFrame, strand: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per TSS and PAS event (and ``by``, e.g. the sample): alternative_reads and primary_reads. ``reads``: gene_id, isoform, ``by``, reads.

    The primary side needs the reads of all isoforms whose far end lies beyond a node; those come from sums per end node and
    a running total over the gene's nodes. An event needs a primary isoform, in whatever sample.
    """
    shape = _ends(path)
    ends = shape.join(reads, ["gene_id", "isoform"])
    out = None
    for plus, group, far, sign in (("TSS", "first_last", "pas", 1), ("PAS", "last_first", "tss", -1)):
        outer = F.min("tss") if plus == "TSS" else F.max("pas")
        own = shape.where("first_last != pas").groupBy("gene_id", F.col(group).alias("n")).agg(outer.alias("outer"), F.count(F.lit(1)).alias("n_own"))
        own = own.join(_beyond(own, shape.withColumn("reads", F.lit(0)), far, sign).select("gene_id", "n", "k"), ["gene_id", "n"]).where("k > n_own").drop("n_own", "k")
        asked = own.join(reads.select("gene_id", *by).distinct(), "gene_id") if by else own
        # what lies strictly beyond n, less the event's own isoforms (they do lie beyond)
        mine = ends.where("first_last != pas").groupBy("gene_id", F.col(group).alias("n"), *by).agg(F.sum("reads").alias("alt"), F.count(F.lit(1)).alias("n_alt"))
        none = F.lit(0).cast("long")
        parts = _beyond(asked, ends, far, sign, by).withColumns({"alt": none, "n_alt": none}).unionByName(mine.withColumns({"r": none, "k": none}))
        got = parts.groupBy("gene_id", "n", *by).agg(F.sum("r").alias("r"), F.sum("k").alias("k"), F.sum("alt").alias("alternative_reads"), F.sum("n_alt").alias("n_alternative")).where("k > 0").join(own, ["gene_id", "n"])
        got = got.withColumns({"primary_reads": F.col("r") - F.col("alternative_reads"), "n_primary": F.col("k") - F.col("n_alternative")})
        a, b = ("outer", "n") if plus == "TSS" else ("n", "outer")
        got = got.select("gene_id", F.lit(plus).alias("t"), F.col(a).alias("node_a"), F.col(b).alias("node_b"), *by, "primary_reads", "alternative_reads", "n_primary", "n_alternative")
        out = got if out is None else out.unionByName(got)
    return out.join(strand, "gene_id").select("gene_id", _by_strand(F.col("t")).alias("event_type"), "node_a", "node_b", *by, "primary_reads", "alternative_reads", "n_primary", "n_alternative")


def _beyond(asked: DataFrame, ends: DataFrame, far: str, sign: int, by: tuple[str, ...] = ()) -> DataFrame:
    """gene_id, n, ``by``, r and k: reads and number of the isoforms whose ``far`` end lies strictly beyond each asked node n."""
    from pyspark.sql import Window

    beyond = ends.groupBy("gene_id", F.col(far).alias("at"), *by).agg(F.sum("reads").alias("r"), F.count(F.lit(1)).alias("k"))
    none = F.lit(0).cast("long")
    both = asked.select("gene_id", F.col("n").alias("at"), *by, none.alias("r"), none.alias("k"), F.lit(True).alias("ask")).unionByName(beyond.withColumn("ask", F.lit(False)))
    order = F.col("at").desc() if sign > 0 else F.col("at").asc()
    w = Window.partitionBy("gene_id", *by).orderBy(order, F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), none).alias(c)
    return both.select("gene_id", F.col("at").alias("n"), *by, "ask", total("r"), total("k")).where("ask").drop("ask")


def with_coordinates(events: DataFrame, segs: DataFrame) -> DataFrame:
    """Adds start and end: between the nodes, or over them for TSS and PAS."""
    a = segs.select("gene_id", F.col("node").alias("node_a"), F.col("start").alias("__as"), F.col("end").alias("__ae"))
    b = segs.select("gene_id", F.col("node").alias("node_b"), F.col("start").alias("__bs"), F.col("end").alias("__be"))
    outer = F.col("event_type").isin("TSS", "PAS")
    rows = events.join(a, ["gene_id", "node_a"]).join(b, ["gene_id", "node_b"])
    return rows.withColumns({"start": F.when(outer, F.col("__as")).otherwise(F.col("__ae")), "end": F.when(outer, F.col("__be")).otherwise(F.col("__bs"))}).drop("__as", "__ae", "__bs", "__be")


def event_totals(events: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """primary_reads, alternative_reads, n_primary, n_alternative per event (and ``by``, e.g. the sample). ``reads``: gene_id, isoform, ``by``, reads."""
    keys = [c for c in (*EVENT, "via") if c in events.columns]
    side = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
    return events.join(reads.drop("gene_id"), "isoform").groupBy(*keys, *by).agg(
        side("primary", F.col("reads")).alias("primary_reads"), side("alternative", F.col("reads")).alias("alternative_reads"),
        side("primary", F.lit(1)).alias("n_primary"), side("alternative", F.lit(1)).alias("n_alternative"),
    )


def frequent(totals: DataFrame, min_total: int = 100, min_alt_fraction: float = 0.1, inclusive: bool = True) -> DataFrame:
    """Events with enough reads, of which the rarer side has the given part (``inclusive``: or just that part)."""
    total = F.col("primary_reads") + F.col("alternative_reads")
    rare = F.least("primary_reads", "alternative_reads")
    enough = (rare >= total * F.lit(min_alt_fraction)) if inclusive else (rare > total * F.lit(min_alt_fraction))
    return totals.where((total >= min_total) & (total > 0) & enough)
