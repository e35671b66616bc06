"""Collapsing of transcripts (or reads) into isoforms by their introns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.functions.intervals import chain_text
from spliceforge.operators.intervals import merge_intervals, overlap_join

#: What tells isoforms apart besides their introns.
PLACE = ["gene_id", "chr", "strand"]


def weighted_quantile(df: DataFrame, keys: list[str], pos: str, weight: str, share: float, name: str) -> DataFrame:
    """``keys`` and the least ``pos`` at which the summed ``weight`` reaches ``share`` of the group's; discrete, not interpolated.

    Weights are summed per position before the window, which therefore sees each position once. Null positions and weights
    that are null or not positive are left out; a group without others gives no row.
    """
    at = df.where(F.col(pos).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, pos).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    run = at.withColumn("__run", F.sum("__w").over(w.orderBy(pos))).withColumn("__all", F.sum("__w").over(w))
    return run.where(F.col("__run") >= F.col("__all") * F.lit(share)).groupBy(*keys).agg(F.min(pos).alias(name))


def single_exon_groups(rows: DataFrame) -> DataFrame:
    """Adds chain: single-exon transcripts of a place that overlap, directly or through others, share one, named by its first start.

    Bounds are doubled and ends taken back by one, so that transcripts which only touch stay apart.
    """
    twice = rows.select(*PLACE, (F.col("tr_start") * 2).alias("lo"), (F.col("tr_end") * 2 - 1).alias("hi"))
    groups = merge_intervals(twice, PLACE, "lo", "hi").where("kind = 'period'")
    groups = groups.select(*PLACE, (F.col("pos_from") / 2).cast("long").alias("group_start"), ((F.col("pos_to") + 1) / 2).cast("long").alias("group_end"))
    named = overlap_join(rows, groups, PLACE, ("tr_start", "tr_end"), ("group_start", "group_end"))
    return named.withColumn("chain", F.concat(F.lit("mono"), F.col("group_start").cast("string"))).drop("group_start", "group_end")


def with_chain(rows: DataFrame) -> DataFrame:
    """Adds tr_start, tr_end and chain, the text that members of one isoform share."""
    ends = rows.withColumns({"tr_start": F.get("exons", F.lit(0))["start"], "tr_end": F.try_element_at("exons", F.lit(-1))["end"]})
    many = ends.where(F.size("exons") > 1).withColumn("chain", chain_text(F.col("exons")))
    return many.unionByName(single_exon_groups(ends.where(F.size("exons") == 1)))


def isoforms(chained: DataFrame) -> DataFrame:
    """One row per isoform: place, chain, isoform (the least transcript_id), exons, n_transcripts, reads.

    Inner exon bounds are those of the chain; the outer ones are the weighted medians of the members' starts and ends,
    members with reads of null or none counting nothing (if no member has reads, the least start and the greatest end).
    Rows with a null in a place belong to no isoform.
    """
    keys = [*PLACE, "__c"]
    rows = chained.withColumn("__c", F.xxhash64("chain", F.lit(1)))
    weight = F.coalesce("coverage", F.lit(0))
    agg = rows.groupBy(*keys, "chain").agg(
        F.min("transcript_id").alias("isoform"), F.count(F.lit(1)).alias("n_transcripts"), F.sum(weight).alias("reads"),
        F.min("tr_start").alias("__lo"), F.max("tr_end").alias("__hi"), F.min_by("exons", "transcript_id").alias("__exons"),
    )
    # both medians in one pass, by 128 bits of hash instead of the text
    both = F.inline(F.array(F.struct(F.lit("s").alias("__k"), F.col("tr_start").alias("__p")), F.struct(F.lit("e").alias("__k"), F.col("tr_end").alias("__p"))))
    ends = rows.where("coverage > 0").select(*keys, F.xxhash64("chain", F.lit(2)).alias("__c2"), "coverage", both)
    median = weighted_quantile(ends, [*keys, "__c2", "__k"], "__p", "coverage", 0.5, "__m")
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col("__m")))
    median = median.groupBy(*keys, "__c2").agg(pick("s").alias("__start"), pick("e").alias("__end"))
    agg = agg.withColumn("__c2", F.xxhash64("chain", F.lit(2))).join(median, [*keys, "__c2"], "left")
    start, end = F.coalesce("__start", "__lo"), F.coalesce("__end", "__hi")
    n = F.size("__exons")

    def bound(x: Column, i: Column) -> Column:
        return F.struct(F.when(i == 0, start).otherwise(x["start"]).alias("start"), F.when(i == n - 1, end).otherwise(x["end"]).alias("end"))

    return agg.select(*PLACE, "chain", "isoform", F.transform("__exons", bound).alias("exons"), "n_transcripts", "reads")


def shift_junctions(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """``rows`` (transcript_id, exons, ...) with introns moved by ``shifts`` (transcript_id, intron_no from 0, shift).

    Donor and acceptor move alike; exons that lose their length are left out.
    """
    by_intron = shifts.groupBy("transcript_id").agg(F.map_from_entries(F.collect_list(F.struct("intron_no", "shift"))).alias("__m"))
    joined = rows.join(by_intron, "transcript_id", "left")
    move = lambda i: F.coalesce(F.col("__m")[i], F.lit(0))
    moved = F.transform("exons", lambda x, i: F.struct((x["start"] + move(i - 1)).alias("start"), (x["end"] + move(i)).alias("end")))
    return joined.withColumn("exons", F.filter(moved, lambda x: x["start"] < x["end"])).drop("__m")


def without_samples(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Transcripts less the given samples; isoforms that only those had go with them."""
    return rows.where(~F.col("sample_name").isin(samples))
