"""Queries over domains, exports and sequences. Sequences are made of the letters A, C, G and T of a post's text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.functions import sequence as S
from spliceforge.operators import bubbles
from spliceforge.operators.depth import depth_profile
from spliceforge.operators.domains import contained, domain_blocks, label_sets
from spliceforge.operators.ends import unify_ends
from spliceforge.operators.intervals import merge_intervals
from spliceforge.operators.packed import packed_integers
from spliceforge.plans import model as M
from spliceforge.plans.problems import P4_SQL
from spliceforge.plans.structure import MIN_TOTAL, REF
from spliceforge.session import materialize, ship_package, table
from spliceforge.sources.export import event_gff_lines, event_layouts, event_paths, gtf_lines, numbered_events


def parsed_domains(spark: SparkSession, d: str) -> DataFrame:
    """domain_id, chr, domain_name, blocks of the domains whose packed sizes and starts have the same slots."""
    rows = table(spark, d, "example_anno_domains")
    items = packed_integers(rows, "domain_id", ["blocksizes", "chromstarts"])
    pick = lambda f: F.transform(F.sort_array(F.collect_list(F.when(F.col("field_name") == f, F.struct("slot_no", "item")))), lambda x: x["item"])
    slots = lambda f: F.sort_array(F.collect_list(F.when(F.col("field_name") == f, F.col("slot_no"))))
    lists = items.groupBy("domain_id").agg(pick("blocksizes").alias("sizes"), pick("chromstarts").alias("starts"), slots("blocksizes").alias("k1"), slots("chromstarts").alias("k2")).where("k1 = k2")
    head = rows.where("chrom is not null and chromstart is not null").groupBy("domain_id").agg(F.min("chrom").alias("chr"), F.min("chromstart").alias("at"), F.min("domain_name").alias("domain_name"))
    return lists.join(head, "domain_id").select("domain_id", "chr", "domain_name", domain_blocks(F.col("at"), F.col("sizes"), F.col("starts")).alias("blocks")).where("blocks is not null")


def domain_block_table(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed_domains(spark, d)
    return rows.select("domain_id", "chr", F.size("blocks").alias("n_blocks"), F.get("blocks", F.lit(0))["start"].alias("d_start"), F.try_element_at("blocks", F.lit(-1))["end"].alias("d_end"))


def protein_chains(spark: SparkSession, d: str, domains: DataFrame) -> DataFrame:
    """transcript_id (chrom and protein), chr, exons: the united blocks of each protein's domains, standing in for its transcript."""
    protein = table(spark, d, "example_anno_domains").where("uniprotid is not null").groupBy("domain_id").agg(F.min("uniprotid").alias("protein"))
    blocks = domains.join(protein, "domain_id").select(F.concat_ws("|", "chr", "protein").alias("transcript_id"), "chr", F.inline("blocks"))
    united = merge_intervals(blocks, ["transcript_id", "chr"], "start", "end").where("kind = 'period'")
    return united.groupBy("transcript_id", "chr").agg(F.sort_array(F.collect_list(F.struct(F.col("pos_from").alias("start"), F.col("pos_to").alias("end")))).alias("exons"))


def domain_containment(spark: SparkSession, d: str) -> DataFrame:
    """Domains whose blocks run along the united blocks of a protein, with their place on them."""
    domains = materialize(parsed_domains(spark, d).select("domain_id", "chr", "blocks"), "domains")
    return contained(materialize(protein_chains(spark, d, domains), "protein-chains"), domains)


def transcript_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains whose blocks run along the exons of a transcript, with their place on it."""
    transcripts = materialize(M.transcripts(spark, d).select("transcript_id", "chr", "exons"), "domain-transcripts")
    return contained(transcripts, materialize(parsed_domains(spark, d).select("domain_id", "chr", "blocks"), "domains"))


def domain_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct domains lie over each stretch of a chromosome."""
    rows = table(spark, d, "example_anno_domains").where("chrom is not null").select(F.col("chrom").alias("chr"), "domain_id", "chromstart", "chromend").distinct()
    return depth_profile(rows.withColumn("one", F.lit(1)), ["chr"], "chromstart", "chromend", "one")


def domain_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per protein, names of its curated domains (A) against those of its predicted ones (B)."""
    rows = table(spark, d, "example_anno_domains").where("uniprotid is not null and domain_name is not null")
    side = lambda t: F.collect_set(F.when(F.col("anno_type") == t, F.col("domain_id")))
    proteins = rows.groupBy("uniprotid").agg(side("curated").alias("a"), side("predicted").alias("b"))
    labels = rows.select(F.col("domain_id").alias("transcript_id"), F.col("domain_name").alias("label")).distinct()
    return label_sets(proteins, "uniprotid", "a", "b", labels, ("A-B", "B-A", "A|B", "A&B")).toDF("uniprotid", "only_a", "only_b", "either", "both")


def gtf_export(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a GTF export of the isoforms, the genes named by their keys."""
    return gtf_lines(M.isoforms(spark, d)).select("chr", "start", "value")


def event_export(spark: SparkSession, d: str) -> DataFrame:
    """Frequent simple events numbered within their kind, as they are written to files."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.simple_event_totals(path, strand, iso.select("gene_id", "isoform", "reads"))
    rows = numbered_events(bubbles.with_coordinates(bubbles.frequent(totals, MIN_TOTAL, 0.1, inclusive=False), segs))
    return rows.select("file", "row_id", "gene_id", "start", "end", "primary_reads", "alternative_reads")


def all_event_export(spark: SparkSession, d: str) -> DataFrame:
    """:func:`event_export` with ME events."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    totals = bubbles.event_totals(M.all_events(path, strand), iso.select("gene_id", "isoform", "reads"))
    rows = numbered_events(bubbles.with_coordinates(bubbles.frequent(totals, MIN_TOTAL, 0.1, inclusive=False), segs))
    return rows.select("file", "row_id", "gene_id", "start", "end", "via", "primary_reads", "alternative_reads")


def _frequent_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Exon paths of both sides of the frequent events, and the place of each gene."""
    iso = M.isoforms(spark, d)
    segs, path, strand = M.graph(iso)
    sides = materialize(M.all_events(path, strand), "event-sides")
    totals = bubbles.event_totals(sides.withColumn("via", F.coalesce("via", F.lit(-1))), iso.select("gene_id", "isoform", "reads"))
    keep = bubbles.frequent(totals, MIN_TOTAL, 0.1, inclusive=False).select(*bubbles.KEY)
    rows = sides.withColumn("via", F.coalesce("via", F.lit(-1))).join(keep, bubbles.KEY, "left_semi")
    return materialize(event_paths(rows, iso, path, segs), "event-paths"), iso.select("gene_id", "chr", "strand").distinct()


def event_layout_export(spark: SparkSession, d: str) -> DataFrame:
    """The exons by which a splicing tool knows the frequent events, numbered within their kind."""
    return event_layouts(_frequent_paths(spark, d)[0])


def event_gff_export(spark: SparkSession, d: str) -> DataFrame:
    """The frequent events as genes whose messengers are the different exon paths of either side."""
    return event_gff_lines(*_frequent_paths(spark, d))


def unified_ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of the transcripts of each gene, in genomic order, moved to peaks."""
    rows = M.in_genes(spark, d).where("coverage > 0").withColumn("gene_id", F.expr(M.GENE_KEY))
    return unify_ends(_end_reads(rows).groupBy("gene_id", "kind", "junction", "pos").agg(F.sum("coverage").alias("n")))


def _end_reads(rows: DataFrame) -> DataFrame:
    """gene_id, transcript_id, kind, junction, pos, coverage: two rows a transcript; junction is null for single exons."""
    spliced = F.size("exons") > 1
    first, last = F.get("exons", F.lit(0))["end"], F.try_element_at("exons", F.lit(-1))["start"]
    end = lambda kind, junction, pos: F.struct(F.lit(kind).alias("kind"), F.when(spliced, junction).alias("junction"), pos.alias("pos"))
    both = F.inline(F.array(end("start", first, F.col("tr_start")), end("end", last, F.col("tr_end"))))
    return rows.select("gene_id", "transcript_id", "coverage", both)


def unified_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The outer bounds of each isoform: of each end, the unified position that most of its reads have (the outermost of equal ones)."""
    rows = materialize(M.chained(spark, d, "coverage > 0").withColumn("gene_id", F.expr(M.GENE_KEY)).select("gene_id", "chain", "transcript_id", "exons", "tr_start", "tr_end", "coverage"), "end-transcripts")
    return majority_bounds(rows)


def majority_bounds(rows: DataFrame) -> DataFrame:
    """gene_id, chain, iso_start, iso_end. ``rows``: gene_id, chain, transcript_id, exons, tr_start, tr_end, coverage."""
    ends = _end_reads(rows)
    moved = unify_ends(ends.groupBy("gene_id", "kind", "junction", "pos").agg(F.sum("coverage").alias("n")))
    key = ["gene_id", "kind", "pos"]
    same = [F.col(f"e.{c}") == F.col(f"m.{c}") for c in key] + [F.col("e.junction").eqNullSafe(F.col("m.junction"))]
    at = ends.join(rows.select("transcript_id", "chain"), "transcript_id").alias("e").join(moved.alias("m"), same).select("e.gene_id", "e.chain", "e.kind", "m.unified_pos", "e.coverage")
    votes = at.groupBy("gene_id", "chain", "kind", "unified_pos").agg(F.sum("coverage").alias("n"))
    outer = F.when(F.col("kind") == "start", -F.col("unified_pos")).otherwise(F.col("unified_pos"))
    best = votes.groupBy("gene_id", "chain", "kind").agg(F.max_by("unified_pos", F.struct(F.col("n"), outer)).alias("at"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    return best.groupBy("gene_id", "chain").agg(pick("start").alias("iso_start"), pick("end").alias("iso_end"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("seq"))


def a_content(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", F.round(S.base_share(F.substring("seq", 1, 30), "A", 30), 4).alias("a_share"))


def all_a_content(spark: SparkSession, d: str) -> DataFrame:
    """Share of A in the 30 bases behind each place of a post on either strand, the places every 30 bases over the whole sequence."""
    rows = _sequences(spark, d).where("length(seq) > 0").select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq"), F.lit(30))).alias("pos"))
    rows = rows.select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    return rows.select("doc_id", "pos", "strand", F.round(S.downstream(F.col("seq"), F.col("pos"), F.col("pos"), F.col("strand")), 4).alias("a_share"))


def window_content(spark: SparkSession, d: str) -> DataFrame:
    """The greatest A or T count of any 30 bases, and where it first is."""
    rows = S.window_content(_sequences(spark, d), "seq", ["doc_id"], 30)
    return rows.groupBy("doc_id").agg(F.max("most").alias("most"), F.max_by("pos", F.struct(F.col("most"), -F.col("pos"))).alias("pos"))


def splice_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Posts by the motif of the intron from base 10 to base 60, on either strand."""
    rows = _sequences(spark, d).where(F.length("seq") >= 60).withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"))
    motif = S.splice_motif(F.col("seq"), F.lit(10), F.lit(60), F.col("strand"))
    return rows.groupBy(motif.alias("motif")).agg(F.count(F.lit(1)).alias("n"))


def all_splice_motifs(spark: SparkSession, d: str, width: int = 50) -> DataFrame:
    """Introns of ``width`` bases from every base of the posts by their motif, on either strand."""
    rows = _sequences(spark, d).where(F.length("seq") >= width).withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"))
    rows = rows.select("seq", "strand", F.explode(F.sequence(F.lit(0), F.length("seq") - width)).alias("pos"))
    motif = S.splice_motif(F.col("seq"), F.col("pos"), F.col("pos") + width, F.col("strand"))
    return rows.groupBy(motif.alias("motif")).agg(F.count(F.lit(1)).alias("n"))


def reading_frames(spark: SparkSession, d: str) -> DataFrame:
    """The chosen open reading frame of each sequence and its protein."""
    ship_package(spark)
    rows = _sequences(spark, d).withColumn("f", S.frame_udf("seq")).where("f.start is not null")
    inner = F.substring(F.col("seq"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    return rows.select("doc_id", "f.start", "f.end", "f.upstream", S.translate_udf(inner).alias("protein"), F.round(S.testcode_udf(inner), 6).alias("testcode"))


def direct_repeats(spark: SparkSession, d: str, delta: int = 15, wobble: int = 2) -> DataFrame:
    """Introns of 50 bases from every base of the posts that has the bases around both ends, by the length of the direct repeat there, at most ``delta``."""
    ship_package(spark)

    side, intron = delta + wobble, 50

    @F.pandas_udf("array<bigint>")
    def counts(seqs: pd.Series) -> pd.Series:
        out = []
        for s in seqs:
            n = [0] * (delta + 1)
            for p in range(side, len(s) - intron - side + 1):
                a, b = s[p - side : p + side], s[p + intron - side : p + intron + side]
                n[min(delta, S.repeat_length(a, b, delta, 2, wobble))] += 1
            out.append(n)
        return pd.Series(out)

    rows = _sequences(spark, d).where(F.length("seq") >= intron + 2 * side).select(F.posexplode(counts("seq")).alias("repeat_length", "k")).where("k > 0")
    return rows.groupBy("repeat_length").agg(F.sum("k").alias("n"))


QUERIES = {f.__name__: f for f in (
    domain_block_table, domain_containment, transcript_domains, domain_depth, domain_label_sets, gtf_export, event_export, all_event_export, event_layout_export, event_gff_export, unified_ends, unified_bounds,
    reverse_complements, a_content, all_a_content, window_content, splice_motifs, all_splice_motifs, reading_frames, direct_repeats,
)}

_SEQ = "sq as (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents where text is not null)"
_BLOCKS = f"""with it as ({P4_SQL}), l as (select domain_id, list(slot_no order by slot_no) filter (where field_name = 'blocksizes') as k1, list(slot_no order by slot_no) filter (where field_name = 'chromstarts') as k2,
    list(item order by slot_no) filter (where field_name = 'blocksizes') as sz, list(item order by slot_no) filter (where field_name = 'chromstarts') as st from it group by 1),
  h as (select domain_id, min(chrom) as chr, min(chromstart) as pos0 from example_anno_domains where chrom is not null and chromstart is not null group by 1),
  b as (select domain_id, chr, unnest(sz) as n, pos0 + unnest(st) as a from l join h using (domain_id) where k1 = k2),
  f as (select *, case when a = lag(a + n) over (partition by domain_id order by a, a + n) then 0 else 1 end as fresh from b)"""
SQL = {
    "domain_block_table": f"{_BLOCKS} select domain_id, any_value(chr) as chr, cast(sum(fresh) as int) as n_blocks, min(a) as d_start, arg_max(a + n, (a, a + n)) as d_end from f group by 1",
    "domain_containment": f"""{_BLOCKS}, g as (select *, sum(fresh) over (partition by domain_id order by a, a + n rows unbounded preceding) as no from f), bl as (select domain_id, chr, no, min(a) as a, arg_max(a + n, (a, a + n)) as b from g group by all),
        pr as (select domain_id, min(uniprotid) as p from example_anno_domains where uniprotid is not null group by 1),
        u as (select distinct chr || '|' || p as tid, chr, a, b from bl join pr using (domain_id) where a < b), u1 as (select *, case when a <= max(b) over (partition by tid order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from u),
        u2 as (select *, sum(fresh) over (partition by tid order by a, b rows unbounded preceding) as no from u1), ex as (select tid, chr, min(a) as s, max(b) as e from u2 group by tid, chr, no),
        bn as (select *, lead(a) over (partition by domain_id order by no) as nxt from bl), dm as (select domain_id, chr, min(a) as ds, min(b) filter (where true) as b0, arg_min(b, no) as fe, arg_max(b, no) as de, arg_min(a, no) as fs,
          coalesce(string_agg(b || '-' || nxt, ',' order by no), '') as introns from bn group by all),
        ct as (select tid, domain_id, fs, de, introns from dm join ex on ex.chr = dm.chr and s <= fs and fe <= e and fs < fe),
        inn as (select ct.tid, domain_id, any_value(fs) as fs, any_value(de) as de, any_value(introns) as introns, list({{'s': s, 'e': e}} order by s) as x from ct join ex on ex.tid = ct.tid and e > fs and s < de group by all),
        ok as (select *, coalesce(array_to_string(list_transform(range(1, len(x)), lambda i: x[i].e || '-' || x[i + 1].s), ','), '') as mine from inn)
        select ok.tid as transcript_id, domain_id, cast(sum(greatest(least(e, fs) - s, 0)) as bigint) as tr_start, cast(sum(greatest(least(e, de) - s, 0)) as bigint) as tr_end
        from ok join ex on ex.tid = ok.tid where mine = introns and de <= x[-1].e group by ok.tid, domain_id, fs, de""",
    "domain_depth": """with p as (select distinct chrom as chr, domain_id, chromstart as a, chromend as b from example_anno_domains where chrom is not null and chromstart < chromend),
        c as (select chr, pos, sum(d) as d from (select chr, a as pos, 1 as d from p union all select chr, b, -1 from p) group by all)
        select chr, pos as pos_from, nxt as pos_to, cast(depth as bigint) as depth from (select chr, pos, lead(pos) over w as nxt, sum(d) over w as depth from c window w as (partition by chr order by pos)) where depth > 0 and nxt is not null""",
    "domain_label_sets": """with x as (select uniprotid, coalesce(list_distinct(list(domain_id) filter (where anno_type = 'curated')), []) as ia, coalesce(list_distinct(list(domain_id) filter (where anno_type = 'predicted')), []) as ib from example_anno_domains where uniprotid is not null and domain_name is not null group by 1),
        n as (select distinct domain_id, domain_name from example_anno_domains where uniprotid is not null and domain_name is not null),
        aa as (select uniprotid, list(distinct domain_name) as a from (select uniprotid, unnest(ia) as domain_id from x) join n using (domain_id) group by 1), bb as (select uniprotid, list(distinct domain_name) as b from (select uniprotid, unnest(ib) as domain_id from x) join n using (domain_id) group by 1),
        y as (select uniprotid, coalesce(a, []) as a, coalesce(b, []) as b from x left join aa using (uniprotid) left join bb using (uniprotid))
        select uniprotid, array_to_string(list_sort(list_filter(a, lambda v: not list_contains(b, v))), ',') as only_a, array_to_string(list_sort(list_filter(b, lambda v: not list_contains(a, v))), ',') as only_b,
        array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as either, array_to_string(list_sort(list_filter(a, lambda v: list_contains(b, v))), ',') as both from y""",
    "gtf_export": f"""with {M.BASE}, {M.sql_iso()}, l as (select i.chr, i.gene, i.strand, isoform, reads, x.exon_no, x.s, x.e, min(x.s) over (partition by isoform) as lo, max(x.e) over (partition by isoform) as hi from iso i join iex x using (isoform)),
        r as (select chr, gene, strand, min(lo) as a, max(hi) as b, 'gene' as k, 'gene_id "' || gene || '";' as txt from l group by all
          union all select distinct chr, gene, strand, lo, hi, 'transcript', 'gene_id "' || gene || '"; transcript_id "' || isoform || '"; reads "' || reads || '";' from l
          union all select chr, gene, strand, s, e, 'exon', 'gene_id "' || gene || '"; transcript_id "' || isoform || '"; exon_number "' || row_number() over (partition by isoform order by s) || '";' from l)
        select chr, a as start, chr || chr(9) || 'spliceforge' || chr(9) || k || chr(9) || (a + 1) || chr(9) || b || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || txt as value from r""",
    "event_export": f"""with {M.BASE}, {M.sql_iso()}, {M.sql_graph()}, {M.SIMPLE_SQL.format(p='')}, tot as (select e.gene, event_type, e.a, e.b, sum(case when side = 'primary' then reads else 0 end) as pr, sum(case when side = 'alternative' then reads else 0 end) as al from sim e join iso i on i.isoform = e.isoform group by all),
        k as (select t.*, x.e as st, y.s as en, case event_type when 'ES' then 'SE' when '3AS' then 'A3SS' when '5AS' then 'A5SS' else 'RI' end as file from tot t join seg x on x.gene = t.gene and x.node = t.a join seg y on y.gene = t.gene and y.node = t.b
          where pr + al >= {MIN_TOTAL} and least(pr, al) > (pr + al) * cast(0.1 as double))
        select file, row_number() over (partition by file order by gene, st, en, a, b) as row_id, gene as gene_id, st as start, en as "end", cast(pr as bigint) as primary_reads, cast(al as bigint) as alternative_reads from k""",
    "reverse_complements": f"with {_SEQ} select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as seq from sq",
    "a_content": f"with {_SEQ} select doc_id, round(length(regexp_replace(seq[1:30], '[^A]', '', 'g')) / 30, 4) as a_share from sq",
    "window_content": f"""with {_SEQ}, w as (select doc_id, seq, unnest(range(0, length(seq) - 29)) as pos from sq where length(seq) >= 30),
        c as (select doc_id, pos, greatest(length(regexp_replace(seq[pos + 1:pos + 30], '[^A]', '', 'g')), length(regexp_replace(seq[pos + 1:pos + 30], '[^T]', '', 'g'))) as most from w)
        select doc_id, cast(max(most) as int) as most, cast(arg_max(pos, (most, -pos)) as int) as pos from c group by 1""",
    "splice_motifs": f"""with {_SEQ}, m as (select doc_id, seq[11:12] || seq[59:60] as four from sq where length(seq) >= 60)
        select case when doc_id % 2 = 0 then four else reverse(translate(four, 'ACGT', 'TGCA')) end as motif, count(*) as n from m group by 1""",
}
