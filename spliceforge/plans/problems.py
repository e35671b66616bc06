"""Queries of the general problems 2, 3, 4 and 7 over the given tables, with DuckDB's SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.operators import intervals as I
from spliceforge.operators.current import current_rows
from spliceforge.operators.packed import packed_integers
from spliceforge.operators.skew import heavy_keys, skew_aggregate
from spliceforge.operators.strict_load import DOMAINS, SAMPLES, rejected, strict_load
from spliceforge.session import table

#: A gene dominates with more than this per cent of a measure.
DOMINANT_PERCENT = 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "example_anno_domains").where("chrom is not null and uniprotid is not null")
    domains = domains.select(F.concat_ws("|", "chrom", "uniprotid").alias("entity"), "chromstart", "chromend")
    merged = I.merge_intervals(domains, ["entity"], "chromstart", "chromend").select(F.lit("example_anno_domains").alias("source_table"), "*")
    starts, ends = I.sorted_bounds(F.col("exons"), "exon_start", "exon_end")
    rows = table(spark, d, "transcript").select("transcript_id", "loaded_at", starts.alias("__s"), ends.alias("__e"))
    opens, closes = I.period_bounds(F.col("__s"), F.col("__e"))
    rows = rows.select("transcript_id", "loaded_at", F.size("__s").alias("__n"), opens.alias("__o"), closes.alias("__c"))
    # only chains with an overlap keep their periods through the shuffle
    touching = F.size("__o") < F.col("__n")
    rows = rows.select("transcript_id", "loaded_at", *[F.when(touching, F.col(c)).alias(c) for c in ("__o", "__c")])
    now = current_rows(rows, "__o", "__c").where("__o is not null")
    exons = now.select(F.lit("transcript").alias("source_table"), F.col("transcript_id").cast("string").alias("entity"), F.inline(I.periods_and_gaps(F.col("__o"), F.col("__c"))))
    return merged.unionByName(exons)


P2_SQL = """
with dom as (select 'example_anno_domains' as source_table, chrom || '|' || uniprotid as entity, chromstart as a, chromend as b
  from example_anno_domains where chromstart < chromend and chrom is not null and uniprotid is not null),
cur as (select transcript_id, exons from transcript where transcript_id is not null
  qualify row_number() over (partition by transcript_id order by loaded_at desc nulls last) = 1),
ex as (select 'transcript' as source_table, cast(transcript_id as varchar) as entity, cast(x.exon_start as bigint) as a, cast(x.exon_end as bigint) as b
  from (select transcript_id, unnest(exons) as x from cur) where x.exon_start < x.exon_end),
iv as (select source_table, entity, a, b, count(*) as c from (select * from dom union all select * from ex) group by all),
mk as (select *, case when a <= max(b) over (partition by source_table, entity order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from iv),
isl as (select *, sum(fresh) over (partition by source_table, entity order by a, b rows unbounded preceding) as no from mk),
per as (select source_table, entity, no, min(a) as a, max(b) as b, sum(c) as n from isl group by all),
keep as (select *, sum(n) over (partition by source_table, entity) - count(*) over (partition by source_table, entity) as joined,
  lead(a) over (partition by source_table, entity order by a) as nxt from per)
select source_table, entity, 'period' as kind, a as pos_from, b as pos_to from keep where source_table = 'example_anno_domains' or joined > 0
union all
select source_table, entity, 'gap', b, nxt from keep where nxt is not null and (source_table = 'example_anno_domains' or joined > 0)
"""


def gene_transcript_counts(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, n_transcripts: distinct transcript_ids listed for the gene."""
    genes = table(spark, d, "gene").where("gene_id is not null")
    listed = genes.select("gene_id", F.explode("transcripts").alias("transcript_id")).where("transcript_id is not null")
    return skew_aggregate(listed, "gene_id", distinct=("n_transcripts", "transcript_id"))


def gene_coverage_sums(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, coverage: summed over the current rows that have a gene."""
    transcripts = table(spark, d, "transcript")
    now = current_rows(transcripts, "gene_id", "coverage").where("gene_id is not null")
    return skew_aggregate(now, "gene_id", sums={"coverage": "coverage"}, heavy=heavy_keys(transcripts, "gene_id"))


def p3_gene_totals(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, n_transcripts, coverage: both measures of every gene."""
    both = gene_transcript_counts(spark, d).join(gene_coverage_sums(spark, d), "gene_id", "full")
    return both.select("gene_id", F.coalesce("n_transcripts", F.lit(0)).alias("n_transcripts"), F.coalesce("coverage", F.lit(0)).alias("coverage"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "gene").where("gene_id is not null").select(F.explode("transcripts").alias("t"))
    counts, sums = gene_transcript_counts(spark, d), gene_coverage_sums(spark, d)
    n_all = listed.agg(F.count_distinct("t").alias("n")).scalar()
    cov_all = sums.agg(F.sum("coverage").alias("c")).scalar()
    over = lambda col, total: F.col(col) * 100 > total * DOMINANT_PERCENT
    return (
        counts.where(over("n_transcripts", n_all)).select("gene_id", F.lit("transcripts").alias("measure"))
        .unionByName(sums.where(over("coverage", cov_all)).select("gene_id", F.lit("coverage").alias("measure")))
    )


GENE_SUMS_SQL = """
cur as (select transcript_id, gene_id, coverage from transcript where transcript_id is not null
  qualify row_number() over (partition by transcript_id order by loaded_at desc nulls last) = 1),
listed as (select distinct gene_id, t from (select gene_id, unnest(transcripts) as t from gene where gene_id is not null) where t is not null),
n as (select gene_id, count(*) as n_transcripts from listed group by 1),
c as (select gene_id, cast(sum(coverage) as bigint) as coverage from cur where gene_id is not null group by 1)
"""
P3_TOTALS_SQL = f"with {GENE_SUMS_SQL} select gene_id, coalesce(n_transcripts, 0) as n_transcripts, coalesce(coverage, 0) as coverage from n full join c using (gene_id)"
P3_SQL = f"""with {GENE_SUMS_SQL}
select gene_id, 'transcripts' as measure from n where n_transcripts * 100 > {DOMINANT_PERCENT} * (select count(distinct t) from listed)
union all select gene_id, 'coverage' from c where coverage * 100 > {DOMINANT_PERCENT} * (select sum(coverage) from c)"""

PACKED = ("blocksizes", "chromstarts", "exonframes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_integers(table(spark, d, "example_anno_domains"), "domain_id", list(PACKED))


_P4_WS = r"[\s\x{85}\x{a0}]"
P4_SQL = rf"""
with t as (select distinct domain_id, field_name, txt from (select domain_id, unnest(['blocksizes', 'chromstarts', 'exonframes']) as field_name,
    unnest([blocksizes, chromstarts, exonframes]) as txt from example_anno_domains) where txt is not null),
b as (select domain_id, field_name, regexp_replace(regexp_replace(txt, '^[\s\[\(\{{<]+', ''), '[\s\]\)\}}>]+$', '') as txt from t),
tok as (select domain_id, field_name, regexp_extract_all(txt, '"[^"]*"|''[^'']*''|\s*[,;|/:]\s*|\s+|[^\s,;|/:"'']+|["'']') as parts from b),
p as (select domain_id, field_name, unnest(parts) as part, generate_subscripts(parts, 1) as i from tok),
s as (select *, regexp_full_match(part, '\s*[,;|/:]\s*|\s+') as sep from p),
n as (select *, 1 + coalesce(sum(cast(sep as int)) over (partition by domain_id, field_name order by i rows between unbounded preceding and 1 preceding), 0) as slot_no from s),
v as (select domain_id, field_name, slot_no, string_agg(case when part[1] in ('"', '''') and length(part) > 1 then replace(trim(part[2:-2]), ',', '') else part end, '' order by i) as item
  from n where not sep group by all)
select distinct domain_id, field_name, cast(slot_no as int) as slot_no, try_cast(item as bigint) as item from v where regexp_full_match(item, '[+-]?[0-9]+')
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "raw_records"), [SAMPLES, DOMAINS])


def p7_samples(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of the sample tables as rows."""
    return strict_load(table(spark, d, "raw_records"), SAMPLES)


def p7_domains(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of the domain tables as rows, numbers as numbers."""
    rows = strict_load(table(spark, d, "raw_records"), DOMAINS)
    starts = F.transform(F.split(F.regexp_replace("chromstarts", ",$", ""), ","), lambda x: x.cast("long"))
    return rows.select("record_id", "domain_id", "chrom", F.col("chromstart").cast("long").alias("chromstart"), F.col("chromend").cast("long").alias("chromend"),
                       "domain_name", F.col("blockcount").cast("long").alias("blockcount"), F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_starts"), "uniprotid")


_P7_FIELD = r'''("[^"]*(?:""[^"]*)*"|[^"\t][^\t]*|)'''
_P7_CTE = rf"""with r as (select record_id, any_value(feed) as feed, any_value(chr(9) || regexp_replace(line, '\r$', '')) as body from raw_records
    where line is not null and not regexp_full_match(line, '\s*') and not starts_with(line, '#') and feed in ('sample_table', 'example_anno_domains') group by record_id),
f as (select *, regexp_full_match(body, '(?:\t{_P7_FIELD})*') as quoted_well, regexp_extract_all(body, '\t{_P7_FIELD}', 1) as raw from r),
v as (select *, list_transform(raw, lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as v from f),
d as (select *, case when regexp_replace(v[13], ',$', '') = '' then [] else string_split(regexp_replace(v[13], ',$', ''), ',') end as items from v),
g as (select *, case when feed = 'sample_table' then regexp_full_match(v[2], '(?s).+\.bam') and not regexp_matches(v[2], '[\s\x00-\x1f\x7f-\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]')
    else regexp_full_match(v[3], '[0-9]+') and regexp_full_match(v[4], '[0-9]+') and regexp_full_match(v[11], '[0-9]+') and try_cast(v[3] as hugeint) < try_cast(v[4] as hugeint)
      and try_cast(v[4] as hugeint) < 2147483648 and try_cast(v[11] as hugeint) = len(items) and len(list_filter(items, lambda x: not regexp_full_match(x, '[0-9]+') or coalesce(try_cast(x as hugeint) >= 2147483648, true))) = 0 end as fine from d),
w as (select *, case when not quoted_well then 'quoting' when len(v) <> case when feed = 'sample_table' then 3 else 30 end then 'column_count' when not coalesce(fine, false) then 'invalid_value' end as reason from g)"""
P7_SQL = f"{_P7_CTE} select record_id, reason from w where reason is not null"
P7_SAMPLES_SQL = f"{_P7_CTE} select record_id, v[1] as sample_name, v[2] as file_name, v[3] as sample_group from w where reason is null and feed = 'sample_table'"
P7_DOMAINS_SQL = f"""{_P7_CTE} select record_id, v[1] as domain_id, v[2] as chrom, cast(v[3] as bigint) as chromstart, cast(v[4] as bigint) as chromend, v[5] as domain_name, cast(v[11] as bigint) as blockcount,
  cast(coalesce(list_sum(list_transform(items, lambda x: cast(x as bigint))), 0) as bigint) as sum_starts, v[29] as uniprotid from w where reason is null and feed <> 'sample_table'"""

QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_gene_totals": p3_gene_totals, "p4_found": p4_found,
    "p7_found": p7_found, "p7_samples": p7_samples, "p7_domains": p7_domains,
}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_gene_totals": P3_TOTALS_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p7_samples": P7_SAMPLES_SQL, "p7_domains": P7_DOMAINS_SQL}
