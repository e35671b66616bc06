"""Protein domains on transcripts: containment of blocks, coordinates of hits, and set algebra of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceforge.functions.intervals import introns, region_length, to_genomic_position
from spliceforge.operators.intervals import overlap_join


def domain_blocks(chrom_start: Column, sizes: Column, starts: Column) -> Column:
    """array<struct<start, end>> on the genome of block sizes and of starts relative to ``chrom_start``; touching blocks are one.

    Null if the numbers of both differ, or a number is missing.
    """
    pairs = F.sort_array(F.zip_with(starts, sizes, lambda s, n: F.struct((chrom_start + s).alias("start"), (chrom_start + s + n).alias("end"))))
    whole = (F.size(starts) == F.size(sizes)) & F.forall(pairs, lambda p: p["end"].isNotNull()) & (F.size(starts) > 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(last["end"] == x["start"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.when(whole, F.aggregate(F.slice(pairs, F.lit(2), F.size(pairs) - 1), F.slice(pairs, 1, 1), step))


def contained(transcripts: DataFrame, domains: DataFrame, in_frame: bool = False) -> DataFrame:
    """transcript_id, domain_id, tr_start, tr_end of the domains whose blocks run along a transcript's exons.

    A domain's introns must be neighbouring introns of the transcript and its outer bounds lie in exons. ``transcripts``: transcript_id, chr, exons and, for
    ``in_frame``, cds (struct<start, end>): the domain must lie in it, a multiple of three bases from its begin. ``domains``: domain_id, chr, blocks. Candidates
    come from the binned overlap of the first block with exons; repeated domains give one row.
    """
    d = domains.withColumns({"d_start": F.get("blocks", F.lit(0))["start"], "d_first_end": F.get("blocks", F.lit(0))["end"], "d_end": F.try_element_at("blocks", F.lit(-1))["end"]}).where("d_start < d_first_end").dropDuplicates(["domain_id", "chr", "blocks"])
    exons = transcripts.select("transcript_id", "chr", F.inline("exons")).withColumnsRenamed({"start": "x_start", "end": "x_end"})
    hit = overlap_join(d, exons, ["chr"], ("d_start", "d_first_end"), ("x_start", "x_end")).where("x_start <= d_start and d_first_end <= x_end")
    both = hit.join(transcripts.select("transcript_id", "exons", *(["cds"] if in_frame else [])), "transcript_id")
    text = lambda c: F.array_join(F.transform(introns(c), lambda i: F.concat_ws("-", i["donor"].cast("string"), i["acceptor"].cast("string"))), ",")
    inner = F.filter("exons", lambda x: (x["end"] > F.col("d_start")) & (x["start"] < F.col("d_end")))
    fits = (text(inner) == text(F.col("blocks"))) & (F.col("d_end") <= F.try_element_at(inner, F.lit(-1))["end"])
    rows = both.where(fits)
    if in_frame:
        frame = region_length(F.col("exons"), F.col("cds")["start"], F.col("d_start")) % 3
        rows = rows.where((F.col("cds")["start"] <= F.col("d_start")) & (F.col("d_end") <= F.col("cds")["end"]) & (frame == 0))
    at = lambda p: region_length(F.col("exons"), F.lit(0), p)
    return rows.select("transcript_id", "domain_id", at(F.col("d_start")).alias("tr_start"), at(F.col("d_end")).alias("tr_end")).distinct()


def hits_on_genome(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Protein hits (transcript_id, accession, start, end in residues from 0) with genomic bounds; ``transcripts`` has orf_start on the transcript."""
    rows = hits.join(transcripts.select("transcript_id", "strand", "exons", "orf_start"), "transcript_id")
    a, b = F.col("orf_start") + F.col("start") * 3, F.col("orf_start") + F.col("end") * 3
    g = lambda p: to_genomic_position(F.col("exons"), F.col("strand"), p)
    return rows.select("transcript_id", "accession", a.alias("tr_start"), b.alias("tr_end"), F.least(g(a), g(b)).alias("g_start"), F.greatest(g(a), g(b)).alias("g_end"))


#: Set expressions over the labels of side A and side B.
MODES = {"A-B": F.array_except, "B-A": lambda a, b: F.array_except(b, a), "A|B": F.array_union, "A&B": F.array_intersect}


def label_sets(table: DataFrame, key: str, side_a: str, side_b: str, labels: DataFrame, modes: tuple[str, ...] = ("A-B", "B-A")) -> DataFrame:
    """``key`` and for each mode the sorted labels, joined by commas. Sides are arrays of transcript ids; ``labels``: transcript_id, label."""
    out = table.select(key)
    for side, name in ((side_a, "__a"), (side_b, "__b")):
        each = table.select(key, F.explode(side).alias("transcript_id")).join(labels, "transcript_id").groupBy(key).agg(F.collect_set("label").alias(name))
        out = out.join(each, key, "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("__a", none), F.coalesce("__b", none)
    return out.select(key, *[F.array_join(F.sort_array(MODES[m](a, b)), ",").alias(m) for m in modes])
