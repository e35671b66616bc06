"""Alignment expressions over CIGAR texts, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR text; null and ``*`` give null and an empty array."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=XB]"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=XB])"), F.lit(1))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def exons_of(ops: Column, offset: Column) -> Column:
    """Exon blocks on the genome from ``offset``: N closes a block, M D = X extend it; blocks without length are left out."""
    start = F.struct(
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"),
        F.struct(offset.cast("long").alias("start"), offset.cast("long").alias("end")).alias("open"),
    )

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]
        kept = F.when(o["start"] < o["end"], F.concat(acc["done"], F.array(o))).otherwise(acc["done"])
        after = o["end"] + x["n"]
        skip, use = x["op"] == "N", x["op"].isin("M", "D", "=", "X")
        done = F.when(skip, kept).otherwise(acc["done"])
        moved = F.when(skip, F.struct(after.alias("start"), after.alias("end"))).when(use, F.struct(o["start"].alias("start"), after.alias("end"))).otherwise(o)
        return F.struct(done.alias("done"), moved.alias("open"))

    finish = lambda acc: F.when(acc["open"]["start"] < acc["open"]["end"], F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(ops, start, step, finish)


def aligned_part(ops: Column, is_reverse: Column) -> Column:
    """struct<start, end>: the stretch of the read that is aligned, in the read's own direction."""
    order = F.when(is_reverse, F.reverse(ops)).otherwise(ops)
    clip = F.when(F.get(order, F.lit(0))["op"].isin("S", "H"), F.get(order, F.lit(0))["n"]).otherwise(F.lit(0).cast("long"))
    used = F.aggregate(order, F.lit(0).cast("long"), lambda n, x: n + F.when(x["op"].isin("M", "I", "=", "X"), x["n"]).otherwise(0))
    return F.struct(clip.alias("start"), (clip + used).alias("end"))


def clipping(ops: Column, pos: Column, ref_end: Column) -> Column:
    """struct<at, n>: a soft clip at the begin as (pos, -n), else one at the end as (ref_end, n), else null."""
    first, last = F.get(ops, F.lit(0)), F.try_element_at(ops, F.lit(-1))
    begin = F.struct(pos.cast("long").alias("at"), (-first["n"]).alias("n"))
    end = F.struct(ref_end.cast("long").alias("at"), last["n"].alias("n"))
    return F.when(first["op"] == "S", begin).when(last["op"] == "S", end)


def error_rate(quality: Column) -> Column:
    """Expected share of wrong bases of an array of Phred qualities, null if it is empty."""
    total = F.aggregate(quality, F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q / 10))
    return F.when(F.size(quality) > 0, total / F.size(quality))
