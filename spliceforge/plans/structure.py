"""Queries over isoforms, segment graphs and splicing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceforge.functions import intervals as X
from spliceforge.operators import bubbles, segments
from spliceforge.operators.intervals import merge_intervals
from spliceforge.plans import model as M

MIN_TOTAL = 20
REF = "category = 0"


def gene_exonic_regions(spark: SparkSession, d: str) -> DataFrame:
    """Union of the exons of each gene's transcripts: gene_id, region_from, region_to."""
    rows = M.in_genes(spark, d).select("gene_id", F.inline("exons"))
    out = merge_intervals(rows, ["gene_id"], "start", "end").where("kind = 'period'")
    return out.select("gene_id", F.col("pos_from").alias("region_from"), F.col("pos_to").alias("region_to"))


def isoform_table(spark: SparkSession, d: str) -> DataFrame:
    iso = M.isoforms(spark, d)
    return iso.select("gene_id", "isoform", "chain", "n_transcripts", "reads", F.size("exons").alias("n_exons"), F.get("exons", F.lit(0))["start"].alias("iso_start"), F.try_element_at("exons", F.lit(-1))["end"].alias("iso_end"))


def intron_support(spark: SparkSession, d: str) -> DataFrame:
    """Introns of each gene with the number of transcripts and reads that have them."""
    rows = M.in_genes(spark, d).select("gene_id", "coverage", F.inline(X.introns(F.col("exons"))))
    return rows.groupBy("gene_id", "donor", "acceptor").agg(F.count(F.lit(1)).alias("n_transcripts"), F.sum(F.coalesce("coverage", F.lit(0))).alias("reads"))


def gene_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segments(segments.exon_rows(M.isoforms(spark, d)))


def segment_paths(spark: SparkSession, d: str) -> DataFrame:
    segs, path, _ = M.graph(M.isoforms(spark, d))
    return path.select("gene_id", "isoform", "node", "exon_no", "pre", "suc", "tss", "pas")


def segment_edges(spark: SparkSession, d: str) -> DataFrame:
    segs, path, _ = M.graph(M.isoforms(spark, d))
    return segments.edges(path)


def segment_restore(spark: SparkSession, d: str) -> DataFrame:
    """Chains rebuilt from the paths, as text."""
    segs, path, _ = M.graph(M.isoforms(spark, d))
    rows = segments.restore(path, segs)
    return rows.select("gene_id", "isoform", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("exon_text"))


def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reads over each segment and the number of isoforms in it (the boxes of a splice plot)."""
    iso = M.isoforms(spark, d)
    segs, path, _ = M.graph(iso)
    return path.join(iso.select("isoform", "reads"), "isoform").groupBy("gene_id", "node").agg(F.sum("reads").alias("reads"), F.count(F.lit(1)).alias("n_isoforms"))


def junction_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reads over each spliced link (the arcs of a splice plot), with its share of the gene's greatest."""
    iso = M.isoforms(spark, d)
    rows = iso.select("gene_id", "reads", F.inline(X.introns(F.col("exons")))).groupBy("gene_id", "donor", "acceptor").agg(F.sum("reads").alias("reads"))
    top = rows.groupBy("gene_id").agg(F.max("reads").alias("top"))
    return rows.join(top, "gene_id").select("gene_id", "donor", "acceptor", "reads", F.round(F.col("reads") / F.nullif("top", F.lit(0)), 6).alias("share_of_top"))


def isoform_fragments(spark: SparkSession, d: str) -> DataFrame:
    """By the exons themselves: their bounds are those of the segments, so a path is a piece of another where the chains are."""
    return segments.chain_fragments(M.isoforms(spark, d))


def splice_events(spark: SparkSession, d: str) -> DataFrame:
    """ES, 3AS, 5AS and IR events with coordinates and the reads of both sides."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.simple_event_totals(path, strand, iso.select("gene_id", "isoform", "reads"))
    return bubbles.with_coordinates(totals, segs)


def exclusive_events(spark: SparkSession, d: str) -> DataFrame:
    iso = M.isoforms(spark, d)
    segs, path, _ = M.graph(iso)
    totals = bubbles.event_totals(bubbles.exclusive_events(path), iso.select("gene_id", "isoform", "reads"))
    return bubbles.with_coordinates(totals, segs)


def end_events(spark: SparkSession, d: str) -> DataFrame:
    """TSS and PAS events."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    return bubbles.with_coordinates(bubbles.end_event_totals(path, strand, iso.select("gene_id", "isoform", "reads")), segs)


def frequent_events(spark: SparkSession, d: str) -> DataFrame:
    """Simple and exclusive events with enough reads on both sides."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.event_totals(M.all_events(path, strand), iso.select("gene_id", "isoform", "reads"))
    return bubbles.frequent(totals, MIN_TOTAL, 0.1, inclusive=True)


def all_frequent_events(spark: SparkSession, d: str) -> DataFrame:
    """:func:`frequent_events` with TSS and PAS."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    return bubbles.frequent(M.all_totals(path, strand, iso.select("gene_id", "isoform", "reads")), MIN_TOTAL, 0.1, inclusive=True)


def event_psi(spark: SparkSession, d: str) -> DataFrame:
    """Per simple event and sample: reads of the alternative side, of both, and their ratio."""
    iso, reads = M.isoforms_and_reads(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.simple_event_totals(path, strand, reads, ("sample_name",))
    total = F.col("primary_reads") + F.col("alternative_reads")
    rows = totals.select(*bubbles.EVENT, "sample_name", F.col("alternative_reads").alias("alt_reads"), total.alias("total_reads"))
    return rows.where("total_reads > 0").withColumn("psi", F.round(F.col("alt_reads") / F.col("total_reads"), 6))


def all_event_psi(spark: SparkSession, d: str) -> DataFrame:
    """:func:`event_psi` over the events of all types; via tells ME events of one A and B apart."""
    iso, reads = M.isoforms_and_reads(spark, d)
    segs, path, strand = M.graph(iso)
    totals = M.all_totals(path, strand, reads, ("sample_name",))
    total = F.col("primary_reads") + F.col("alternative_reads")
    rows = totals.select(*bubbles.KEY, "sample_name", F.col("alternative_reads").alias("alt_reads"), total.alias("total_reads"))
    return rows.where("total_reads > 0").withColumn("psi", F.round(F.col("alt_reads") / F.col("total_reads"), 6))


def event_known(spark: SparkSession, d: str) -> DataFrame:
    """Simple events by coordinates, and whether the reference isoforms (full splice matches) alone show them too."""
    def coords(only: str) -> DataFrame:
        segs, path, strand = M.graph(M.isoforms(spark, d, only))
        events = bubbles.simple_events(path, strand).select(*bubbles.EVENT).distinct()
        return bubbles.with_coordinates(events, segs).select("gene_id", "event_type", "start", "end").distinct()

    known = coords(REF).withColumn("known", F.lit(True))
    return coords("true").join(known, ["gene_id", "event_type", "start", "end"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def all_event_known(spark: SparkSession, d: str) -> DataFrame:
    """:func:`event_known` over the events of all types; via_start is where the primary exon nearest to A of an ME event begins."""
    def coords(only: str) -> DataFrame:
        iso = M.isoforms(spark, d, only)
        segs, path, strand = M.graph(iso)
        events = M.all_totals(path, strand, iso.select("gene_id", "isoform", "reads")).select(*bubbles.KEY)
        via = segs.select("gene_id", F.col("node").alias("via"), F.col("start").alias("via_start"))
        return bubbles.with_coordinates(events, segs).join(via, ["gene_id", "via"], "left").select("gene_id", "event_type", "start", "end", "via_start").distinct()

    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("gene_id", "event_type", "start", "end", "via_start")]
    return coords("true").alias("a").join(coords(REF).withColumn("known", F.lit(True)).alias("b"), same, "left").select("a.*", F.coalesce("known", F.lit(False)).alias("known"))


def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frequent events and distinct genes of each type."""
    rows = frequent_events(spark, d)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("gene_id").alias("n_genes"))


def event_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Distance from each frequent event to the next one of its gene, by start (negative: they overlap)."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.simple_event_totals(path, strand, iso.select("gene_id", "isoform", "reads"))
    rows = bubbles.with_coordinates(bubbles.frequent(totals, MIN_TOTAL, 0.1), segs)
    w = Window.partitionBy("gene_id").orderBy("start", "end", "event_type", "node_a", "node_b")
    return rows.select("gene_id", "event_type", "start", "end", (F.lead("start").over(w) - F.least(F.col("end"), F.lead("end").over(w))).alias("distance"))


def splice_site_support(spark: SparkSession, d: str) -> DataFrame:
    """Per transcript of a gene: splice sites, and how many of them reference isoforms of the gene have."""
    rows = M.in_genes(spark, d)
    site = F.inline(F.flatten(F.transform(X.introns(F.col("exons")), lambda i: F.array(F.struct(F.lit("donor").alias("side"), i["donor"].alias("pos")), F.struct(F.lit("acceptor").alias("side"), i["acceptor"].alias("pos"))))))
    ref = rows.where(REF).select("gene_id", site).distinct().withColumn("hit", F.lit(1))
    mine = rows.select("gene_id", "transcript_id", site)
    return mine.join(ref, ["gene_id", "side", "pos"], "left").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_sites"), F.count("hit").alias("n_known"))


def fsm_match(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts whose introns equal those of a full-splice-match transcript of the gene from another sample."""
    rows = M.in_genes(spark, d).where(F.size("exons") > 1).withColumn("chain", X.chain_text(F.col("exons")))
    ref = rows.where(REF).groupBy("gene_id", "strand", "chain").agg(F.min("transcript_id").alias("ref_transcript"), F.count(F.lit(1)).alias("n_ref"))
    return rows.select("transcript_id", "gene_id", "strand", "chain").join(ref, ["gene_id", "strand", "chain"]).select("transcript_id", "ref_transcript", "n_ref")


def partial_match(spark: SparkSession, d: str) -> DataFrame:
    """Isoforms of two or more introns whose introns are a contiguous part of a longer isoform's: isoform, container.

    Candidates meet on the first intron, and are compared as text.
    """
    iso = M.isoforms(spark, d).where("chain not like 'mono%'").select("gene_id", "isoform", "chain", F.split("chain", ",").alias("i"))
    part = iso.where(F.size("i") > 1).select("gene_id", "isoform", F.col("chain").alias("part"), F.get("i", F.lit(0)).alias("intron"))
    whole = iso.select("gene_id", F.col("isoform").alias("container"), F.col("chain").alias("whole"), F.explode("i").alias("intron"))
    return part.join(whole, ["gene_id", "intron"]).where("part != whole and position(concat(',', part, ',') in concat(',', whole, ',')) > 0").select("gene_id", "isoform", "container")


def fuzzy_junctions(spark: SparkSession, d: str, size: int = 5) -> DataFrame:
    """Introns that the reference isoforms lack but have at a shift of up to ``size`` on both sides: the least such shift.

    Both sides shift alike, so the intron's length is part of the join key.
    """
    rows = M.in_genes(spark, d).select("transcript_id", "gene_id", "category", F.posexplode(X.introns(F.col("exons"))).alias("intron_no", "i"))
    rows = rows.select("transcript_id", "gene_id", "category", "intron_no", F.col("i.donor").alias("donor"), (F.col("i.acceptor") - F.col("i.donor")).alias("len"))
    ref = rows.where(REF).select("gene_id", "len", F.col("donor").alias("ref_donor")).distinct()
    near = rows.join(ref, ["gene_id", "len"]).withColumn("shift", F.col("ref_donor") - F.col("donor")).where(F.abs("shift") <= size)
    best = near.groupBy("transcript_id", "intron_no").agg(F.min_by("shift", F.abs(F.col("shift")) * 2 + (F.col("shift") > 0).cast("int")).alias("shift"))
    return best.where("shift != 0")


def transcript_positions(spark: SparkSession, d: str) -> DataFrame:
    """Transcript coordinates of each transcript's middle position, and back."""
    rows = M.transcripts(spark, d).withColumn("mid", F.floor((F.col("tr_start") + F.col("tr_end")) / 2))
    at = X.to_transcript_position(F.col("exons"), F.col("strand"), F.col("mid"))
    half = F.floor(X.exonic_length(F.col("exons")) / 2)
    return rows.select("transcript_id", "mid", at.alias("tr_pos"), X.to_genomic_position(F.col("exons"), F.col("strand"), half).alias("genomic_half"))


QUERIES = {f.__name__: f for f in (
    gene_exonic_regions, isoform_table, intron_support, gene_segments, segment_paths, segment_edges, segment_restore, segment_coverage, junction_coverage,
    isoform_fragments, splice_events, exclusive_events, end_events, frequent_events, all_frequent_events, event_psi, all_event_psi, event_known, all_event_known, event_type_counts, event_neighbours,
    splice_site_support, fsm_match, partial_match, fuzzy_junctions, transcript_positions,
)}

_ISO = f"with {M.BASE}, {M.sql_iso()}"
_GRAPH = f"{_ISO}, {M.sql_graph()}"
_SIM = f"{_GRAPH}, {M.SIMPLE_SQL.format(p='')}"
_TOT = """tot as (select e.gene, event_type, e.a, e.b, sum(case when side = 'primary' then reads else 0 end) as primary_reads,
  sum(case when side = 'alternative' then reads else 0 end) as alternative_reads, sum(cast(side = 'primary' as int)) as n_primary, sum(cast(side = 'alternative' as int)) as n_alternative
  from sim e join iso i on i.isoform = e.isoform group by all)"""
_TOTALS = "cast(primary_reads as bigint) as primary_reads, cast(alternative_reads as bigint) as alternative_reads, cast(n_primary as bigint) as n_primary, cast(n_alternative as bigint) as n_alternative"
_METOT = """metot as (select e.gene, e.a, e.c, e.b, sum(case when side = 'primary' then reads else 0 end) as primary_reads, sum(case when side = 'alternative' then reads else 0 end) as alternative_reads,
  sum(cast(side = 'primary' as int)) as n_primary, sum(cast(side = 'alternative' as int)) as n_alternative from me e join iso i on i.isoform = e.isoform group by all)"""
_FREQ = f"""{_SIM}, {_TOT}, {M.ME_SQL.format(p='')}, {_METOT},
both_ as (select gene, event_type, a, b, cast(null as int) as via, primary_reads, alternative_reads, n_primary, n_alternative from tot
  union all select gene, 'ME', a, c, b, primary_reads, alternative_reads, n_primary, n_alternative from metot),
freq as (select * from both_ where primary_reads + alternative_reads >= {MIN_TOTAL} and least(primary_reads, alternative_reads) >= (primary_reads + alternative_reads) * cast(0.1 as double))"""
_COORD = "join seg x on x.gene = t.gene and x.node = t.a join seg y on y.gene = t.gene and y.node = t.b"
_SITES = """st as (select t.transcript_id, gene_id, category, 'donor' as side, x.e as pos from tr t join ex3 x using (transcript_id) where nxt is not null and gene_id is not null
  union all select t.transcript_id, gene_id, category, 'acceptor', nxt from tr t join ex3 x using (transcript_id) where nxt is not null and gene_id is not null)"""
_END = """en as (select gene, strand, isoform, min(tss) as tss, max(pas) as pas, arg_min(exon_last, node) as fl, arg_max(exon_first, node) as lf from pth group by all),
te as (select gene, strand, fl as n, min(tss) as o from en where fl <> pas group by all), pe as (select gene, strand, lf as n, max(pas) as o from en where fl <> pas group by all),
ev as (select t.gene, case when t.strand = '-' then 'PAS' else 'TSS' end as event_type, t.o as a, t.n as b, x.fl = t.n and x.fl <> x.pas as own, reads
    from te t join en x on x.gene = t.gene and x.pas > t.n join iso i on i.isoform = x.isoform
  union all select t.gene, case when t.strand = '-' then 'TSS' else 'PAS' end, t.n, t.o, x.lf = t.n and x.fl <> x.pas, reads
    from pe t join en x on x.gene = t.gene and x.tss < t.n join iso i on i.isoform = x.isoform),
t as (select gene, event_type, a, b, sum(case when own then 0 else reads end) as primary_reads, sum(case when own then reads else 0 end) as alternative_reads,
  sum(cast(not own as int)) as n_primary, sum(cast(own as int)) as n_alternative from ev group by all having sum(cast(not own as int)) > 0)"""
#: Isoforms (of pr) whose path is a piece of another's.
FRAGMENT_SQL = """w as (select gene, strand, isoform, ',' || string_agg(node, ',' order by node) || ',' as nodes, count(*) as n, max(exon_no) as ne, min(node) as f from pth group by all),
  pr as (select a.gene, a.strand, a.isoform, b.isoform as container, a.ne, b.ne as bne, a.f from w a join w b on a.gene = b.gene and a.isoform <> b.isoform and contains(b.nodes, a.nodes) and (a.n < b.n or b.isoform < a.isoform))"""

SQL = {
    "gene_exonic_regions": f"""with {M.BASE}, u0 as (select distinct gene_id, s, e from exons join tr using (transcript_id) where gene_id is not null), u as (select gene_id, s, e, case when s <= max(e) over (partition by gene_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from u0),
        v as (select *, sum(f) over (partition by gene_id order by s, e rows unbounded preceding) as no from u) select gene_id, min(s) as region_from, max(e) as region_to from v group by gene_id, no""",
    "isoform_table": f"{_ISO} select gene as gene_id, isoform, chain, n_transcripts, reads, cast((select max(exon_no) from iex x where x.isoform = iso.isoform) as int) as n_exons, iso_start, iso_end from iso",
    "intron_support": f"with {M.BASE} select gene_id, e as donor, nxt as acceptor, count(*) as n_transcripts, cast(sum(coalesce(coverage, 0)) as bigint) as reads from ex3 join tr using (transcript_id) where nxt is not null and gene_id is not null group by all",
    "gene_segments": f'{_GRAPH} select gene as gene_id, node, s as start, e as "end" from seg',
    "segment_paths": f"{_GRAPH} select gene as gene_id, isoform, node, cast(exon_no as int) as exon_no, pre, suc, tss, pas from pth",
    "segment_edges": f"{_GRAPH} select gene as gene_id, node as node_a, suc as node_b, suc_s > e as spliced, count(*) as n_isoforms from pth where suc is not null group by all",
    "segment_restore": f"{_ISO} select gene as gene_id, isoform, string_agg(s || '-' || e, ',' order by exon_no) as exon_text from iex group by all",
    "segment_coverage": f"{_GRAPH} select p.gene as gene_id, node, cast(sum(reads) as bigint) as reads, count(*) as n_isoforms from pth p join iso i using (isoform) group by all",
    "junction_coverage": f"""{_ISO}, j as (select gene, isoform, e as donor, lead(s) over (partition by isoform order by exon_no) as acceptor from iex),
        r as (select j.gene, donor, acceptor, sum(reads) as reads from j join iso using (isoform) where acceptor is not null group by all)
        select gene as gene_id, donor, acceptor, cast(reads as bigint) as reads, round(reads / nullif(max(reads) over (partition by gene), 0), 6) as share_of_top from r""",
    "isoform_fragments": f"""{_GRAPH}, {FRAGMENT_SQL}, kp as (select pr.*, p.exon_no - 1 as low, bne - ne - p.exon_no + 1 as high from pr join pth p on p.isoform = container and p.node = pr.f where container not in (select isoform from pr))
        select gene as gene_id, isoform, container, cast(case when strand = '-' then high else low end as int) as missing_5, cast(case when strand = '-' then low else high end as int) as missing_3 from kp""",
    "splice_events": f'{_SIM}, {_TOT} select t.gene as gene_id, event_type, a as node_a, b as node_b, {_TOTALS}, x.e as start, y.s as "end" from tot t {_COORD}',
    "exclusive_events": f"""{_GRAPH}, {M.ME_SQL.format(p='')}, {_METOT}
        select t.gene as gene_id, 'ME' as event_type, t.a as node_a, t.c as node_b, t.b as via, {_TOTALS}, x.e as start, y.s as "end" from metot t join seg x on x.gene = t.gene and x.node = t.a join seg y on y.gene = t.gene and y.node = t.c""",
    "end_events": f'{_GRAPH}, {_END} select t.gene as gene_id, event_type, t.a as node_a, t.b as node_b, {_TOTALS}, x.s as start, y.e as "end" from t {_COORD}',
    "frequent_events": f"{_FREQ} select gene as gene_id, event_type, a as node_a, b as node_b, via, {_TOTALS} from freq",
    "event_psi": f"""{_SIM}, sr as (select isoform, c.sample_name, sum(coalesce(c.coverage, 0)) as reads from ch c join iso i using (gene_id, chr, strand, chain) group by all),
        p as (select e.gene, event_type, e.a, e.b, sample_name, sum(case when side = 'alternative' then reads else 0 end) as alt_reads, sum(reads) as total_reads from sim e join sr using (isoform) group by all)
        select gene as gene_id, event_type, a as node_a, b as node_b, sample_name, cast(alt_reads as bigint) as alt_reads, cast(total_reads as bigint) as total_reads, round(alt_reads / total_reads, 6) as psi from p where total_reads > 0""",
    "all_event_psi": f"""{_SIM}, {M.ME_SQL.format(p='')}, {M.ALL_SQL}, sr as (select isoform, c.sample_name, sum(coalesce(c.coverage, 0)) as reads from ch c join iso i using (gene_id, chr, strand, chain) group by all),
        p as (select e.gene, event_type, e.a, e.b, via, sample_name, sum(case when side = 'alternative' then reads else 0 end) as alt_reads, sum(reads) as total_reads from evs e join sr using (isoform) group by all)
        select gene as gene_id, event_type, a as node_a, b as node_b, via, sample_name, cast(alt_reads as bigint) as alt_reads, cast(total_reads as bigint) as total_reads, round(alt_reads / total_reads, 6) as psi from p where total_reads > 0""",
    "event_known": f"""{_SIM}, {M.sql_iso('r_', REF)}, {M.sql_graph('r_')}, {M.SIMPLE_SQL.format(p='r_')},
        k as (select distinct t.gene, event_type, x.e as st, y.s as en from (select distinct gene, event_type, a, b from r_sim) t join r_seg x on x.gene = t.gene and x.node = t.a join r_seg y on y.gene = t.gene and y.node = t.b)
        select distinct t.gene as gene_id, t.event_type, x.e as start, y.s as "end", k.gene is not null as known from (select distinct gene, event_type, a, b from sim) t {_COORD}
        left join k on k.gene = t.gene and k.event_type = t.event_type and k.st = x.e and k.en = y.s""",
    "event_type_counts": f"{_FREQ} select event_type, count(*) as n_events, count(distinct gene) as n_genes from freq group by 1",
    "event_neighbours": f"""{_SIM}, {_TOT}, f as (select t.gene, event_type, t.a, t.b, x.e as st, y.s as en from tot t {_COORD}
          where primary_reads + alternative_reads >= {MIN_TOTAL} and least(primary_reads, alternative_reads) >= (primary_reads + alternative_reads) * cast(0.1 as double))
        select gene as gene_id, event_type, st as start, en as "end", lead(st) over w - least(en, lead(en) over w) as distance from f window w as (partition by gene order by st, en, event_type, a, b)""",
    "splice_site_support": f"""with {M.BASE}, {_SITES}, rf as (select distinct gene_id, side, pos, 1 as hit from st where {REF})
        select transcript_id, count(*) as n_sites, count(hit) as n_known from st left join rf using (gene_id, side, pos) group by 1""",
    "fsm_match": f"""with {M.BASE}, rf as (select gene_id, strand, chain0, min(transcript_id) as ref_transcript, count(*) as n_ref from tr where gene_id is not null and n_exons > 1 and {REF} group by all)
        select transcript_id, ref_transcript, n_ref from tr join rf using (gene_id, strand, chain0) where n_exons > 1""",
    "partial_match": f"""{_ISO}, c as (select gene, isoform, chain, len(string_split(chain, ',')) as n, split_part(chain, ',', 1) as f from iso where chain not like 'mono%'),
        w as (select gene, isoform, chain, unnest(string_split(chain, ',')) as f from c)
        select c.gene as gene_id, c.isoform, w.isoform as container from c join w on w.gene = c.gene and w.f = c.f where c.n > 1 and c.chain <> w.chain and contains(',' || w.chain || ',', ',' || c.chain || ',')""",
    "fuzzy_junctions": f"""with {M.BASE}, j as (select t.transcript_id, gene_id, category, x.exon_no - 1 as intron_no, x.e as donor, nxt - x.e as len from ex3 x join tr t using (transcript_id) where nxt is not null and gene_id is not null),
        rf as (select distinct gene_id, len, donor as rd from j where {REF}), n as (select transcript_id, intron_no, rd - donor as shift from j join rf using (gene_id, len) where abs(rd - donor) <= 5),
        b as (select transcript_id, intron_no, arg_min(shift, abs(shift) * 2 + cast(shift > 0 as int)) as shift from n group by all)
        select transcript_id, cast(intron_no as int) as intron_no, shift from b where shift <> 0""",
    "transcript_positions": f"""with {M.BASE}, m as (select *, (tr_start + tr_end) // 2 as mid, case when strand = '-' then len - len // 2 else len // 2 end as fw from tr),
        c as (select transcript_id, s, e, sum(e - s) over (partition by transcript_id order by exon_no rows between unbounded preceding and 1 preceding) as done from exons)
        select m.transcript_id, mid, cast(case when bool_or(mid between s and e) then case when any_value(strand) = '-' then any_value(len) - sum(greatest(least(e, mid) - s, 0)) else sum(greatest(least(e, mid) - s, 0)) end end as bigint) as tr_pos,
          cast(coalesce(min(case when fw >= coalesce(done, 0) and fw < coalesce(done, 0) + e - s then s + fw - coalesce(done, 0) end), max(e)) as bigint) as genomic_half
        from m join c using (transcript_id) group by m.transcript_id, mid""",
}
