"""Row numbers over any number of rows without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.session import fresh, materialize


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name`` (int64, from 1 within ``keys``, by ``order``): rows are spread by ranges and written once, numbered within each range,
    and offset by what the ranges before hold (a row a range and key).

    Rows that tie in ``order`` are numbered in any order; null keys match nothing, so leave them out before. With no keys all rows are
    one group; an empty table stays empty.
    """
    tile, n, offset = fresh(df.columns, "tile", "n", "offset")
    tiled = materialize(df.repartitionByRange(*keys, *order).withColumn(tile, F.spark_partition_id()), "tiles")
    sizes = tiled.groupBy(*keys, tile).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, tile, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    within = F.row_number().over(Window.partitionBy(*keys, tile).orderBy(*order))
    return tiled.withColumn(name, within).join(offsets, [*keys, tile]).withColumn(name, F.col(name) + F.col(offset)).select(*df.columns, name)
