"""The transcriptome as frames: current transcripts with clean exon chains, their isoforms and segment graphs, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.operators import bubbles, collapse, segments
from spliceforge.operators.current import current_rows
from spliceforge.operators.intervals import period_bounds, sorted_bounds
from spliceforge.session import materialize, table

CATEGORIES = ("FSM", "ISM", "NIC", "NNC", "NOVEL")


def transcripts(spark: SparkSession, d: str, *needed: str) -> DataFrame:
    """Current transcripts on a known strand, with exons united to ascending, disjoint ones (array<struct<start, end>>).

    transcript_id, sample_name, gene_id, chr, strand, exons, coverage, a_content, category, subs, tr_start, tr_end; transcripts
    without a valid exon are left out, gene_id may be null. With ``needed``, only these of the table's columns pass the shuffle, besides
    place and exons.
    """
    inner = {c: F.col(f"annotation.{c}").alias(c) for c in ("category", "subs")}
    cols = [inner.get(c, c) for c in ("sample_name", "gene_id", "gene_name", "chr", "strand", "exons", "coverage", "downstream_a_content", *inner) if not needed or c in ("chr", "strand", "exons", *needed)]
    now = current_rows(table(spark, d, "transcript"), *cols).where("chr is not null and strand in ('+', '-')")
    starts, ends = sorted_bounds(F.col("exons"), "exon_start", "exon_end")
    now = now.withColumns({"__s": starts, "__e": ends}).drop("exons")
    opens, closes = period_bounds(F.col("__s"), F.col("__e"))
    now = now.withColumns({"__o": opens, "__c": closes}).where(F.size("__o") > 0)
    exons = F.zip_with("__o", "__c", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    now = now.withColumn("exons", exons).withColumns({"tr_start": F.get("__o", F.lit(0)), "tr_end": F.try_element_at("__c", F.lit(-1))})
    now = now.drop("__s", "__e", "__o", "__c")
    if "downstream_a_content" not in now.columns:
        return now
    content = F.when(~F.isnan("downstream_a_content"), F.col("downstream_a_content"))
    return now.withColumn("a_content", content).drop("downstream_a_content")


def in_genes(spark: SparkSession, d: str, *needed: str) -> DataFrame:
    return transcripts(spark, d, *needed).where("gene_id is not null")


def chained(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Transcripts of genes (those for which ``only`` holds) with the chain that tells their isoform; written, as chains are found in several passes."""
    rows = in_genes(spark, d, "sample_name", "gene_id", "coverage", "category").where(only).drop("category")
    return collapse.with_chain(materialize(rows, "gene-transcripts"))


#: A gene at one place: transcripts of one gene_id on another chromosome or strand form a gene of their own.
GENE_KEY = "concat_ws('|', gene_id, chr, strand)"


def isoforms(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Isoforms with gene_id replaced by the gene's key (see GENE_KEY), so that a graph has one strand. Written once; their chained transcripts
    aren't, which are read twice only."""
    return _keyed(chained(spark, d, only))


def _keyed(rows: DataFrame) -> DataFrame:
    return materialize(collapse.isoforms(rows).withColumn("gene_id", F.expr(GENE_KEY)), "isoforms")


def isoforms_and_reads(spark: SparkSession, d: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """Isoforms, and gene_id (key), isoform, sample_name, reads, both from chained transcripts that are written once."""
    rows = materialize(chained(spark, d, only), "chained")
    iso = _keyed(rows)
    key = [F.expr(GENE_KEY).alias("gene_id"), "chain"]
    reads = rows.groupBy(*key, "sample_name").agg(F.sum(F.coalesce("coverage", F.lit(0))).alias("reads"))
    reads = reads.join(iso.select("gene_id", "chain", "isoform"), ["gene_id", "chain"]).select("gene_id", "isoform", "sample_name", "reads")
    return iso, materialize(reads, "isoform-reads")


def graph(iso: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, paths and the strand of each gene. Segments and exons' nodes are written once; a path's nodes are rolled out where they are read."""
    rows = segments.exon_rows(iso)
    segs = materialize(segments.segments(rows), "segments")
    return segs, segments.paths(materialize(segments.spans(rows, segs), "spans")), iso.groupBy("gene_id").agg(F.first("strand").alias("strand"))


def all_events(path: DataFrame, strand: DataFrame) -> DataFrame:
    """The simple and mutually exclusive events, isoform by isoform; via is null but for ME."""
    simple = bubbles.simple_events(path, strand).withColumn("via", F.lit(None).cast("int"))
    return simple.unionByName(bubbles.exclusive_events(path).withColumn("via", F.col("via").cast("int")))


def all_totals(path: DataFrame, strand: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of the events of all types, TSS and PAS included; via is part of the key."""
    ends = bubbles.end_event_totals(path, strand, reads, by)
    via = lambda rows: rows.withColumn("via", F.lit(None).cast("int"))
    simple, me = bubbles.simple_event_totals(path, strand, reads, by), bubbles.event_totals(bubbles.exclusive_events(path), reads, by)
    return via(simple).unionByName(me.withColumn("via", F.col("via").cast("int"))).unionByName(via(ends))


# ------------------------------------------------------------------ the same for DuckDB
BASE = """
cur as (select * from transcript where transcript_id is not null
  qualify row_number() over (partition by transcript_id order by loaded_at desc nulls last) = 1),
ex0 as (select distinct transcript_id, cast(x.exon_start as bigint) as a, cast(x.exon_end as bigint) as b from
  (select transcript_id, unnest(exons) as x from cur where chr is not null and strand in ('+', '-')) where x.exon_start < x.exon_end),
ex1 as (select *, case when a <= max(b) over (partition by transcript_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from ex0),
ex2 as (select *, sum(fresh) over (partition by transcript_id order by a, b rows unbounded preceding) as exon_no from ex1),
exons as (select transcript_id, exon_no, min(a) as s, max(b) as e from ex2 group by transcript_id, exon_no),
ex3 as (select *, lead(s) over (partition by transcript_id order by exon_no) as nxt from exons),
tr as (select c.transcript_id, sample_name, gene_id, gene_name, chr, strand, coverage, annotation.category as category, annotation.subs as subs,
    case when not isnan(downstream_a_content) then downstream_a_content end as a_content, n_exons, tr_start, tr_end, len, chain0
  from cur c join (select transcript_id, count(*) as n_exons, min(s) as tr_start, max(e) as tr_end, cast(sum(e - s) as bigint) as len,
    string_agg(e || '-' || nxt, ',' order by exon_no) as chain0 from ex3 group by 1) x using (transcript_id))"""
ISO_TEMPLATE = """
{p}mono0 as (select transcript_id, gene_id, chr, strand, tr_start, tr_end, case when tr_start < max(tr_end) over
    (partition by gene_id, chr, strand order by tr_start, tr_end, transcript_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
  from tr where n_exons = 1 and gene_id is not null and ({only})),
{p}mono1 as (select *, sum(fresh) over (partition by gene_id, chr, strand order by tr_start, tr_end, transcript_id rows unbounded preceding) as no from {p}mono0),
{p}mono as (select transcript_id, 'mono' || min(tr_start) over (partition by gene_id, chr, strand, no) as chain from {p}mono1),
{p}ch as (select tr.*, coalesce(m.chain, chain0) as chain from tr left join {p}mono m using (transcript_id) where gene_id is not null and ({only})),
{p}med_s as (select gene_id, chr, strand, chain, min(tr_start) as ms from (select *, sum(w) over (partition by gene_id, chr, strand, chain order by tr_start) as run,
    sum(w) over (partition by gene_id, chr, strand, chain) as total from (select gene_id, chr, strand, chain, tr_start, sum(coverage) as w from {p}ch where coverage > 0 group by all))
  where run >= total * 0.5 group by all),
{p}med_e as (select gene_id, chr, strand, chain, min(tr_end) as me from (select *, sum(w) over (partition by gene_id, chr, strand, chain order by tr_end) as run,
    sum(w) over (partition by gene_id, chr, strand, chain) as total from (select gene_id, chr, strand, chain, tr_end, sum(coverage) as w from {p}ch where coverage > 0 group by all))
  where run >= total * 0.5 group by all),
{p}iso0 as (select gene_id, chr, strand, chain, min(transcript_id) as isoform, count(*) as n_transcripts, cast(sum(coalesce(coverage, 0)) as bigint) as reads,
  min(tr_start) as lo, max(tr_end) as hi from {p}ch group by all),
{p}iso as (select gene_id || '|' || chr || '|' || strand as gene, i.*, coalesce(ms, lo) as iso_start, coalesce(me, hi) as iso_end
  from {p}iso0 i left join {p}med_s using (gene_id, chr, strand, chain) left join {p}med_e using (gene_id, chr, strand, chain)),
{p}iex as (select gene, strand, isoform, exon_no, case when exon_no = 1 then iso_start else s end as s,
  case when exon_no = max(exon_no) over (partition by isoform) then iso_end else e end as e from {p}iso join exons on exons.transcript_id = isoform)"""
GRAPH_TEMPLATE = """
{p}bnd as (select gene, pos, sum(d) as d from (select gene, s as pos, 1 as d from {p}iex union all select gene, e, -1 from {p}iex) group by all),
{p}swp as (select gene, pos as s, lead(pos) over (partition by gene order by pos) as e, sum(d) over (partition by gene order by pos) as depth from {p}bnd),
{p}seg as (select gene, cast(row_number() over (partition by gene order by s) - 1 as int) as node, s, e from {p}swp where depth > 0),
{p}pth0 as (select x.gene, x.strand, x.isoform, x.exon_no, g.node, g.s, g.e from {p}iex x join {p}seg g on g.gene = x.gene and g.s >= x.s and g.e <= x.e),
{p}pth as (select *, lag(node) over w as pre, lead(node) over w as suc, lag(e) over w as pre_e, lead(s) over w as suc_s,
  min(node) over (partition by gene, isoform) as tss, max(node) over (partition by gene, isoform) as pas,
  min(node) over (partition by gene, isoform, exon_no) as exon_first, max(node) over (partition by gene, isoform, exon_no) as exon_last
  from {p}pth0 window w as (partition by gene, isoform order by node))"""


def sql_iso(prefix: str = "", only: str = "true") -> str:
    return ISO_TEMPLATE.format(p=prefix, only=only)


def sql_graph(prefix: str = "") -> str:
    return GRAPH_TEMPLATE.format(p=prefix)


SIMPLE_SQL = """
{p}dir as (select gene, strand, isoform, node as a, suc as b from {p}pth where suc > node + 1),
{p}dp as (select distinct gene, strand, a, b from {p}dir),
{p}alt as (select dp.gene, dp.a, dp.b, x.isoform, case when x.suc_s = x.e and y.pre_e = y.s then 'IR'
    when x.suc_s = x.e then case when dp.strand = '-' then '3AS' else '5AS' end
    when y.pre_e = y.s then case when dp.strand = '-' then '5AS' else '3AS' end else 'ES' end as event_type
  from {p}dp dp join {p}pth x on x.gene = dp.gene and x.node = dp.a and x.suc < dp.b and x.pas > dp.b
  join {p}pth y on y.gene = dp.gene and y.isoform = x.isoform and y.node = dp.b),
{p}sim as (select gene, event_type, a, b, 'alternative' as side, isoform from {p}alt
  union all select e.gene, event_type, e.a, e.b, 'primary', isoform from (select distinct gene, event_type, a, b from {p}alt) e join {p}dir d on d.gene = e.gene and d.a = e.a and d.b = e.b)"""
ME_SQL = """
{p}exn as (select gene, isoform, exon_no, min(node) as f, max(node) as l from {p}pth group by all),
{p}hop as (select x.gene, x.isoform, x.l as a, y.f as bf, y.l as bl, z.f as c from {p}exn x join {p}exn y on y.gene = x.gene and y.isoform = x.isoform and y.exon_no = x.exon_no + 1
  join {p}exn z on z.gene = x.gene and z.isoform = x.isoform and z.exon_no = x.exon_no + 2),
{p}met as (select h.gene, h.a, h.c, h.isoform, d.bf as b from {p}hop h join (select distinct gene, a, bf, c from {p}hop) d on d.gene = h.gene and d.a = h.a and d.c = h.c and d.bf > h.bl),
{p}frs as (select distinct gene, a, c, b from (select gene, a, c, isoform, min(b) as b from {p}met group by all)),
{p}me as (select m.gene, m.a, m.c, m.b, 'alternative' as side, m.isoform from {p}met m join {p}frs f on f.gene = m.gene and f.a = m.a and f.c = m.c and f.b = m.b
  union all select f.gene, f.a, f.c, f.b, 'primary', h.isoform from {p}frs f join {p}hop h on h.gene = f.gene and h.a = f.a and h.c = f.c and h.bf >= f.b)"""
#: The isoforms on either side of the events of all types; after SIMPLE_SQL and ME_SQL.
ALL_SQL = """
en as (select gene, strand, isoform, min(tss) as tss, max(pas) as pas, arg_min(exon_last, node) as fl, arg_max(exon_first, node) as lf from pth group by all),
te as (select gene, strand, fl as n, min(tss) as o from en where fl <> pas group by all), pe as (select gene, strand, lf as n, max(pas) as o from en where fl <> pas group by all),
ev as (select t.gene, case when t.strand = '-' then 'PAS' else 'TSS' end as event_type, t.o as a, t.n as b, x.fl = t.n and x.fl <> x.pas as own, x.isoform from te t join en x on x.gene = t.gene and x.pas > t.n
  union all select t.gene, case when t.strand = '-' then 'TSS' else 'PAS' end, t.n, t.o, x.lf = t.n and x.fl <> x.pas, x.isoform from pe t join en x on x.gene = t.gene and x.tss < t.n),
evo as (select *, sum(cast(not own as int)) over (partition by gene, event_type, a, b) as others from ev),
evs as (select gene, event_type, a, b, cast(null as int) as via, side, isoform from sim union all select gene, 'ME', a, c, b, side, isoform from me
  union all select gene, event_type, a, b, null, case when own then 'alternative' else 'primary' end, isoform from evo where others > 0)"""
