"""Queries of problems 1, 5, 6, 8, 9 and 10 over the given tables, with DuckDB's SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.llm import mixing
from spliceforge.llm.components import connected_groups
from spliceforge.llm.quantiles import percentiles, summarize
from spliceforge.llm.spans import WIDTH, shared_spans
from spliceforge.llm.tokenize import count_tokens, encode_texts
from spliceforge.llm.topn import top_per_group
from spliceforge.operators.current import current_rows
from spliceforge.operators.intervals import period_bounds, sorted_bounds
from spliceforge.operators.skew import heavy_keys, skew_lookup
from spliceforge.session import materialize, table

CURRENT_SQL = """select * from transcript where transcript_id is not null
  qualify row_number() over (partition by transcript_id order by loaded_at desc nulls last) = 1"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    now = current_rows(table(spark, d, "transcript"), "sample_name", "gene_id", F.col("annotation.category").alias("category"), "coverage")
    rows = now.where("gene_id is not null and category is not null and coverage is not null")
    top = top_per_group(rows, ["sample_name", "gene_id", "category"], "coverage", "transcript_id", 3)
    return top.select("sample_name", "gene_id", "category", "rank_no", "transcript_id")


P1_SQL = f"""with cur as ({CURRENT_SQL}), r as (select sample_name, gene_id, annotation.category as category, transcript_id,
  cast(row_number() over (partition by sample_name, gene_id, annotation.category order by coverage desc, transcript_id) as int) as rank_no
  from cur where gene_id is not null and annotation.category is not null and coverage is not null)
select sample_name, gene_id, category, rank_no, transcript_id from r where rank_no <= 3"""

MEASURES = ("coverage", "downstream_a_content")


def p5_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summaries of both measures for each sample."""
    now = current_rows(table(spark, d, "transcript"), "sample_name", *MEASURES)
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES]))
    return summarize(now.select("sample_name", each), ["sample_name", "measure"], "value")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles(p5_summaries(spark, d), {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})
    return rows.drop("quantile_values", "rank_min", "rank_max")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles(p5_summaries(spark, d), {"median": 0.5, "high": 0.9})
    keep = ((F.col("measure") == "coverage") & (F.col("median") >= 10)) | ((F.col("measure") == "downstream_a_content") & (F.col("high") > 0.5))
    return rows.where(keep).select("sample_name", "measure")


P5_SQL = f"""with cur as ({CURRENT_SQL})
select sample_name, 'coverage' as measure from cur where coverage is not null group by 1 having quantile_disc(coverage, 0.5) >= 10
union all select sample_name, 'downstream_a_content' from cur where downstream_a_content is not null and not isnan(downstream_a_content)
group by 1 having quantile_disc(downstream_a_content, 0.9) > 0.5"""


def confirmed_matches(spark: SparkSession, d: str) -> DataFrame:
    """tr_a < tr_b of the matches that strand and exons confirm, each pair once.

    The exons of a transcript are first united into periods; two transcripts overlap if the periods of both, put
    together and their starts and ends sorted, hold a start before the end ranked ahead of it.
    """
    matches = table(spark, d, "transcript_match").where("tr_a != tr_b")
    pairs = matches.select(F.least("tr_a", "tr_b").alias("tr_a"), F.greatest("tr_a", "tr_b").alias("tr_b")).distinct()
    heavy = heavy_keys(matches.select(F.explode(F.array("tr_a", "tr_b")).alias("t")), "t")
    starts, ends = sorted_bounds(F.col("exons"), "exon_start", "exon_end")
    now = current_rows(table(spark, d, "transcript").where("transcript_id is not null"), "chr", "strand", "exons").where("chr is not null and strand in ('+', '-')")
    now = now.select("transcript_id", "chr", "strand", starts.alias("__s"), ends.alias("__e"))
    opens, closes = period_bounds(F.col("__s"), F.col("__e"))  # names of their own, as an alias "s" would capture the closes' "s"
    now = now.select("transcript_id", F.concat("strand", "chr").alias("place"), opens.cast("array<int>").alias("s"), closes.cast("array<int>").alias("e")).where(F.size("s") > 0)
    now = materialize(now, "match-chains")  # both sides and the heavy keys look it up
    side = lambda x: now.toDF(f"id_{x}", f"place_{x}", f"s_{x}", f"e_{x}")
    one = skew_lookup(pairs, side("a"), "tr_a", "id_a", heavy)
    both = skew_lookup(one, side("b"), "tr_b", "id_b", heavy).where("place_a = place_b")
    both = both.select("tr_a", "tr_b", F.sort_array(F.concat("s_a", "s_b")).alias("s"), F.sort_array(F.concat("e_a", "e_b")).alias("e"))
    return both.where(F.exists(F.zip_with(F.slice("s", F.lit(2), F.size("s") - 1), F.slice("e", F.lit(1), F.size("e") - 1), lambda s, e: s < e), lambda x: x)).select("tr_a", "tr_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(confirmed_matches(spark, d), "tr_a", "tr_b").withColumnRenamed("node", "transcript_id")


def p6_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """group_id, n_members."""
    return p6_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))


P6_LINKS = f"""cur as (select transcript_id, chr, strand, exons from ({CURRENT_SQL}) where strand in ('+', '-')),
ex as (select transcript_id, chr, strand, x.exon_start as s, x.exon_end as e from (select transcript_id, chr, strand, unnest(exons) as x from cur) where x.exon_start < x.exon_end),
pairs as (select distinct least(tr_a, tr_b) as a, greatest(tr_a, tr_b) as b from transcript_match where tr_a <> tr_b),
ok as (select distinct a, b from pairs join ex x on x.transcript_id = a join ex y on y.transcript_id = b
  where x.chr = y.chr and x.strand = y.strand and x.s < y.e and y.s < x.e),
links as (select a, b from ok union all select b, a from ok)"""
P6_CTE = f"""with recursive {P6_LINKS},
cc(transcript_id, group_id) using key (transcript_id) as (
  select a, min(least(a, b)) from links group by a
  union select l.b, min(c.group_id) from cc c join links l on l.a = c.transcript_id join recurring.cc r on r.transcript_id = l.b
  where c.group_id < r.group_id group by l.b)"""
P6_SQL = f"{P6_CTE} select transcript_id, group_id from cc"
P6_SIZES_SQL = f"{P6_CTE} select group_id, count(*) as n_members from cc group by 1"


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("record_id"), "text")
    return count_tokens(docs)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """One row for each use of a post in the mixture that meets the shares of mix_target."""
    return mixing.mix_sources(token_counts(spark, d), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and reached share of each source."""
    return mixing.mix_sources(token_counts(spark, d), table(spark, d, "mix_target"))[1]


def p9_full(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture as large as the sources are: the exponent is bisected to where the limits of use hold."""
    return mixing.mix_sources(token_counts(spark, d), table(spark, d, "mix_target"), full_size=True)[1]


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture by temperature: token shares to the exponent at which their entropy is that of the targets."""
    return mixing.mix_sources(token_counts(spark, d), table(spark, d, "mix_target"), by_entropy=True)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_points, shared_points, n_spans of every post; null texts have no points."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"))
    spans = p10_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared_points"), F.count(F.lit(1)).alias("n_spans"))
    return docs.join(spans, "doc_id", "left").na.fill(0, ["shared_points", "n_spans"])


P10_CTE = f"""with g as (select doc_id, i, substring(text, i + 1, {WIDTH}) as w from
    (select doc_id, text, unnest(range(0, length(text) - {WIDTH - 1})) as i from documents where length(text) >= {WIDTH})),
m as (select w from g group by w having min(doc_id) <> max(doc_id)),
s as (select doc_id, i from g where w in (select w from m)),
f as (select *, case when i <= lag(i) over (partition by doc_id order by i) + {WIDTH} then 0 else 1 end as fresh from s),
r as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as no from f),
spans as (select doc_id, min(i) as span_from, max(i) + {WIDTH} as span_to from r group by doc_id, no)"""
P10_SQL = f"{P10_CTE} select doc_id, span_from, span_to from spans"
P10_SHARES_SQL = f"""{P10_CTE}, t as (select doc_id, cast(sum(span_to - span_from) as bigint) as shared_points, count(*) as n_spans from spans group by 1)
select doc_id, coalesce(length(text), 0) as n_points, coalesce(shared_points, 0) as shared_points, coalesce(n_spans, 0) as n_spans
from documents left join t using (doc_id)"""

QUERIES = {
    "p1_found": p1_found, "p5_found": p5_found, "p5_percentiles": p5_percentiles, "p6_found": p6_found, "p6_group_sizes": p6_group_sizes,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_full": p9_full, "p9_tempered": p9_tempered, "p10_found": p10_found, "p10_shares": p10_shares,
}
SQL = {"p1_found": P1_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL, "p6_group_sizes": P6_SIZES_SQL, "p10_found": P10_SQL, "p10_shares": P10_SHARES_SQL}
