"""Histograms with numpy's bin rule: bins are [a, b), the last [a, b]; values outside are left out, empty bins are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, low: float, high: float, n: int) -> Column:
    """Number of the bin from 0, null outside."""
    x = value.cast("double")
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / n)), F.lit(n - 1)).cast("int"))


def histogram(df: DataFrame, value: Column, low: float, high: float, n: int, by: str, weight: Column | None = None) -> DataFrame:
    """``by``, bin_no, count for every bin of every value of ``by`` that occurs. Null values and weights count nothing."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    counts = df.groupBy(by, bin_of(value, low, high, n).alias("bin_no")).agg(F.sum(w).cast("long").alias("count"))
    bins = counts.select(by).distinct().withColumn("bin_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return bins.join(counts, [by, "bin_no"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
