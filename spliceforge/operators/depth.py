"""Depth of coverage over positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth_profile(blocks: DataFrame, keys: list[str], start: str, end: str, weight: str, tile: int = 1_000_000) -> DataFrame:
    """``keys``, pos_from, pos_to, depth: runs of equal bounds between which ``weight`` sums to more than 0.

    Depth is the running sum of +weight at starts and -weight at ends. Changes are summed per position first; the running sum
    is taken within tiles of ``tile`` positions, to which the sum of the tiles before is added, so no chromosome is sorted in
    one task. Null bounds, empty blocks and null weights count nothing.
    """
    w = F.coalesce(F.col(weight), F.lit(0))
    change = F.inline(F.array(F.struct(F.col(start).alias("pos"), w.alias("d")), F.struct(F.col(end).alias("pos"), (-w).alias("d"))))
    at = blocks.where(F.col(start) < F.col(end)).select(*keys, change).groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    at = at.withColumn("__t", F.floor(F.col("pos") / tile))
    tiles = at.groupBy(*keys, "__t").agg(F.sum("d").alias("__sum"), F.min("pos").alias("__first"))
    t = Window.partitionBy(*keys).orderBy("__t")
    tiles = tiles.select(*keys, "__t", F.coalesce(F.sum("__sum").over(t.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lead("__first").over(t).alias("__next"))
    p = Window.partitionBy(*keys, "__t").orderBy("pos")
    run = at.withColumns({"__run": F.sum("d").over(p), "__to": F.lead("pos").over(p)}).join(tiles, [*keys, "__t"])
    out = run.select(*keys, F.col("pos").alias("pos_from"), F.coalesce("__to", "__next").alias("pos_to"), (F.col("__run") + F.col("__before")).alias("depth"))
    return out.where("depth > 0 and pos_to is not null")
