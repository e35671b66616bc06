"""Aggregation and lookup by key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch tracks; every key with more than about 4 / TRACKED of the rows is found.
TRACKED = 4_096


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys with at least ``share`` of the rows, as a frame of one column ``key``: at most 1 / ``share`` + 1 rows.

    A frequent-items sketch per partition, merged; it may miss or add keys near the limit, so it steers only how rows are
    processed, never what comes out. Null keys are never heavy; an empty table has none.
    """
    k = min(TRACKED, int(1 / share) + 1)
    keys = df.select(F.col(key).alias("__key")).where("__key is not null")
    row = keys.selectExpr("count(1) as n", f"approx_top_k(__key, {k}, {TRACKED}) as top").first()
    found = [(x["item"],) for x in (row["top"] or []) if x["count"] >= max(2, share * row["n"])]
    return df.sparkSession.createDataFrame(found, df.select(F.col(key)).schema)


def skew_aggregate(df: DataFrame, key: str, sums: dict[str, str] | None = None, distinct: tuple[str, str] | None = None, heavy: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """Per-key sums and, if asked, a distinct count: columns ``key``, those of ``sums``, ``distinct[0]``.

    ``sums`` maps a new name to a column; ``distinct`` is (new name, column). Keys of ``heavy`` (by default those that a
    sketch finds) are picked by a broadcast join and aggregated in ``salts`` parts each, split by the value to be counted,
    so that parts hold different values and their counts add up; all other keys take the ordinary shuffle.

    A null key is a group of its own, null values count nothing (the sum of only nulls is null), repeated rows are summed
    each time, an empty table gives no row. Extra columns aren't read.
    """
    sums = sums or {}
    heavy = heavy_keys(df, key) if heavy is None else heavy
    used = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__s{i}") for i, c in enumerate(sums.values())], *([F.col(distinct[1]).alias("__d")] if distinct else []))
    small = F.broadcast(heavy.toDF("__key"))
    aggs = [F.sum(f"__s{i}").alias(n) for i, n in enumerate(sums)] + ([F.count_distinct("__d").alias(distinct[0])] if distinct else [])
    light = used.join(small, "__key", "left_anti").groupBy("__key").agg(*aggs)
    salt = F.pmod(F.xxhash64("__d"), F.lit(salts)) if distinct else F.pmod(F.spark_partition_id(), F.lit(salts))
    parts = used.join(small, "__key").groupBy("__key", salt.alias("__salt")).agg(*aggs)
    dense = parts.groupBy("__key").agg(*[F.sum(n).alias(n) for n in [*sums, *([distinct[0]] if distinct else [])]])
    return light.unionByName(dense).withColumnRenamed("__key", key)


def skew_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key; rows of the ``heavy`` keys are joined by broadcast.

    What is broadcast is ``right`` restricted to ``heavy``, which has a bounded number of rows. Null keys match nothing and
    stay with ``how='left'``.
    """
    keys = F.broadcast(heavy.toDF("__heavy"))
    dense = left.join(keys, F.col(left_key) == F.col("__heavy"), "left_semi")
    thin = left.join(keys, F.col(left_key) == F.col("__heavy"), "left_anti")
    few = F.broadcast(right.join(keys, F.col(right_key) == F.col("__heavy"), "left_semi"))
    on = F.col(left_key) == F.col(right_key)
    return thin.join(right, on, how).unionByName(dense.join(few, on, how))
