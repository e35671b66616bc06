"""Interval and exon-chain expressions. Exon chains are arrays of struct<start, end>, ascending, half-open, genomic order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def has_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e1 > s2) & (e2 > s1)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared bases, 0 if none; null if a bound is null."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), (s1 * 0).cast("long"))


def interval_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases between two intervals; negative: shared bases."""
    return F.greatest(s1, s2) - F.least(e1, e2)


def compare_positions(a: Column, b: Column, dead_zone: int = 3) -> Column:
    """1, -1 or 0, where differences under ``dead_zone`` count as none."""
    return F.when(F.abs(a - b) < dead_zone, 0).when(a < b, -1).otherwise(1)


def introns(exons: Column) -> Column:
    """array<struct<donor, acceptor>> between neighbouring exons; empty for one exon."""
    tail = F.slice(exons, F.lit(2), F.greatest(F.size(exons) - 1, F.lit(0)))
    head = F.slice(exons, F.lit(1), F.greatest(F.size(exons) - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.struct(a["end"].alias("donor"), b["start"].alias("acceptor")))


def chain_text(exons: Column) -> Column:
    """Text that two chains of several exons share exactly if their introns are equal."""
    return F.array_join(F.transform(introns(exons), lambda i: F.concat_ws("-", i["donor"].cast("string"), i["acceptor"].cast("string"))), ",")


def exonic_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def splice_identical(a: Column, b: Column) -> Column:
    """Same introns; for two single exons, an overlap."""
    one = (F.size(a) == 1) & (F.size(b) == 1)
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    return F.when(one, has_overlap(x["start"], x["end"], y["start"], y["end"])).otherwise((F.size(a) == F.size(b)) & (chain_text(a) == chain_text(b)))


def region_length(exons: Column, start: Column, end: Column) -> Column:
    """Exonic bases within [start, end)."""
    part = lambda x: F.greatest(F.least(x["end"], end) - F.greatest(x["start"], start), F.lit(0))
    return F.aggregate(exons, F.lit(0).cast("long"), lambda n, x: n + part(x))


def coding_lengths(exons: Column, cds_start: Column, cds_end: Column, strand: Column) -> Column:
    """struct<utr5, cds, utr3> of exonic bases before, in and behind the coding region, as read on the strand."""
    low = region_length(exons, F.lit(0), cds_start)
    high = region_length(exons, cds_end, F.lit(2**40))
    minus = strand == "-"
    return F.struct(F.when(minus, high).otherwise(low).alias("utr5"), region_length(exons, cds_start, cds_end).alias("cds"), F.when(minus, low).otherwise(high).alias("utr3"))


def to_transcript_position(exons: Column, strand: Column, pos: Column) -> Column:
    """Transcript coordinate of a genomic position; an exon's end counts as in it, null in introns and outside."""
    inside = F.exists(exons, lambda x: (x["start"] <= pos) & (pos <= x["end"]))
    before = region_length(exons, F.lit(0), pos)
    return F.when(inside, F.when(strand == "-", exonic_length(exons) - before).otherwise(before))


def to_genomic_position(exons: Column, strand: Column, offset: Column) -> Column:
    """Genomic position of a transcript coordinate, null beyond the transcript."""
    total = exonic_length(exons)
    forward = F.when(strand == "-", total - offset).otherwise(offset)
    walk = F.aggregate(
        exons,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda acc, x: F.struct(
            (acc["seen"] + x["end"] - x["start"]).cast("long").alias("seen"),
            F.coalesce(acc["at"], F.when(forward < acc["seen"] + x["end"] - x["start"], (x["start"] + forward - acc["seen"]).cast("long"))).alias("at"),
        ),
    )
    last = F.try_element_at(exons, F.lit(-1))["end"]
    return F.when((offset < 0) | (offset > total), None).otherwise(F.coalesce(walk["at"], F.when(forward == total, last.cast("long"))))


def is_exonic(exons: Column, pos: Column) -> Column:
    """Whether a position lies in an exon or at its end."""
    return F.exists(exons, lambda x: (x["start"] <= pos) & (pos <= x["end"]))


def shared_sites(a: Column, b: Column) -> Column:
    """Splice sites (ends but the last, starts but the first) that two chains have in common."""
    return F.size(F.array_intersect(introns(a)["donor"], introns(b)["donor"])) + F.size(F.array_intersect(introns(a)["acceptor"], introns(b)["acceptor"]))


def shared_bases(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + region_length(b, x["start"], x["end"]))


def is_same_gene(a: Column, b: Column, site_share: float = 0.0, base_share: float = 0.5) -> Column:
    """Whether of the sites, or of the bases, that either of two chains has, both have more than the given part."""
    sites, bases = shared_sites(a, b), shared_bases(a, b)
    all_sites, all_bases = (F.size(a) + F.size(b) - 2) * 2 - sites, exonic_length(a) + exonic_length(b) - bases
    over = lambda n, total, share: F.coalesce(n > total * F.lit(share), F.lit(False)) & (total > 0)
    return over(sites, all_sites, site_share) | over(bases, all_bases, base_share)
