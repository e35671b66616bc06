"""Percentiles with bounded rank error from mergeable summaries.

A summary is a sorted list of (value, least rank, greatest rank) of some of the n values, the smallest and the greatest among
them. Any rank lies within half the widest step from the greatest rank of one tuple back to the least of the one before; that
is the rank error, which compressing raises by a known amount and merging adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spliceforge.llm.runs import RunFinder
from spliceforge.session import fresh, ship_package

#: Tuples a summary is compressed to; each compression adds at most n / (2 * TUPLES) to the rank error.
TUPLES = 512
#: Summaries merged in one call.
FAN_IN = 64
FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()), T.StructField("quantile_values", T.ArrayType(T.DoubleType())),
    T.StructField("rank_min", T.ArrayType(T.LongType())), T.StructField("rank_max", T.ArrayType(T.LongType())),
]

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def rank_error(s: Summary) -> int:
    """Greatest distance of a rank from the nearest tuple's possible ranks, rounded up."""
    _, low, high = s
    return 0 if len(low) < 2 else int((np.max(high[1:] - low[:-1]) + 1) // 2)


def compress(s: Summary, n: int, tuples: int = TUPLES) -> Summary:
    """At most ``tuples`` + 2 tuples: for ranks at even distances the last tuple whose greatest rank isn't beyond it."""
    values, low, high = s
    if len(values) <= tuples:
        return s
    at = np.searchsorted(high, np.linspace(1, n, tuples), "right") - 1
    keep = np.unique(np.concatenate([[0], np.maximum(at, 0), [len(values) - 1]]))
    return values[keep], low[keep], high[keep]


def merge(parts: list[Summary], sizes: list[int]) -> Summary:
    """The summary of all values: a tuple's ranks add those of its neighbours in every other part."""
    values = np.concatenate([p[0] for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    low, high = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for k, (_, lo, hi) in enumerate(parts):
        own = owner == k
        seen = np.cumsum(own)
        low += np.where(seen > 0, lo[np.maximum(seen - 1, 0)], 0)
        following = np.minimum(seen, len(hi) - 1)
        high += np.where(own, hi[np.maximum(seen - 1, 0)], np.where(seen < len(hi), hi[following] - 1, sizes[k]))
    return values, low, high


def select(s: Summary, n: int, share: float) -> float | None:
    """The value whose rank is within the error of ``share`` of n."""
    values, low, high = s
    if not n:
        return None
    rank = max(1, int(np.ceil(share * n)))
    return float(values[np.argmin(np.maximum(rank - low, high - rank))])


def _summarize(keys: list[str], value: str, part: str, schema: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_no = TaskContext.get().partitionId()
        finder, run, n, first = RunFinder(keys), ([], [], []), 0, None

        def row() -> tuple:
            s = compress(joined(run), n)
            return first, n, rank_error(s), *s

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            new = finder.starts(batch)
            cuts = np.flatnonzero(new)
            done = []
            bounds = [0, *cuts.tolist(), batch.num_rows] if not new[0] else [*cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if new[a]:
                    if first is not None:
                        done.append(row())
                    run, n, first = ([], [], []), 0, batch.select(keys).slice(a, 1)
                ranks = np.arange(n + 1, n + b - a + 1)
                for x, y in zip(run, (values[a:b], ranks, ranks)):
                    x.append(y)
                n += b - a
                if sum(map(len, run[0])) > 64 * TUPLES:
                    run = tuple([x] for x in compress(joined(run), n, 8 * TUPLES))
            yield from _rows(done, keys, part_no, schema)
        if first is not None:
            yield from _rows([row()], keys, part_no, schema)

    def joined(run: tuple) -> Summary:
        return tuple(np.concatenate(x) for x in run)

    def _rows(done: list[tuple], keys: list[str], part_no: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not done:
            return
        head = pa.Table.from_batches([d[0] for d in done]).combine_chunks().to_batches()[0]
        cols = [head.column(i) for i in range(len(keys))] + [pa.array([part_no] * len(done), pa.int64())]
        cols += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
        for i, kind in ((3, pa.float64()), (4, pa.int64()), (5, pa.int64())):
            sizes = np.cumsum([0, *[len(d[i]) for d in done]])
            cols.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([d[i] for d in done]), kind)))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return emit


def _merged(keys: list[str], part: str, schema: pa.Schema):
    def one(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        parts, sizes = [], rows.column("n").to_pylist()
        lists = [rows.column(c).combine_chunks() for c in ("quantile_values", "rank_min", "rank_max")]
        for i in range(len(rows)):
            parts.append(tuple(x[i].values.to_numpy(zero_copy_only=False) for x in lists))
        while len(parts) > 1:
            groups = [(parts[i : i + FAN_IN], sizes[i : i + FAN_IN]) for i in range(0, len(parts), FAN_IN)]
            sizes = [sum(z) for _, z in groups]
            parts = [compress(merge(p, z), sum(z)) for p, z in groups]
        s, n = parts[0], sizes[0]
        head = rows.select([*keys, part]).slice(0, 1)
        cols = [head.column(i).combine_chunks() for i in range(len(keys) + 1)]
        cols += [pa.array([n], pa.int64()), pa.array([rank_error(s)], pa.int64()), *[pa.array([x], pa.list_(t)) for x, t in zip(s, (pa.float64(), pa.int64(), pa.int64()))]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return one


def _check_keys(keys: list[str]) -> None:
    if clash := {k.lower() for k in keys} & {f.name for f in FIELDS}:
        raise ValueError(f"keys can't be named {', '.join(sorted(clash))}")


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Summary of ``value`` for each group: ``keys``, n, rank_error, quantile_values, rank_min, rank_max.

    Within each partition values are sorted by group and streamed into one summary a group, whatever the group's size; the
    summaries are then merged by group, first in buckets of ``FAN_IN`` partitions where there are more. The result can be
    stored and combined with others by :func:`combine`.

    Null and NaN values are left out and so are groups without others; null keys are a group of their own; infinities and
    repeated rows count like any value; an empty table gives no row.
    """
    _check_keys(keys)
    spark = df.sparkSession
    ship_package(spark)
    h, v, p = fresh(keys, "hash", "value", "part")
    rows = df.select(*keys, F.col(value).cast("double").alias(v)).where(F.col(v).isNotNull() & ~F.isnan(v)).withColumn(h, F.xxhash64(*keys))
    rows = rows.sortWithinPartitions(h, *keys, v)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(p, T.LongType()), *FIELDS])
    leaves = rows.mapInArrow(_summarize(keys, v, p, to_arrow_schema(schema)), schema)
    merger = _merged(keys, p, to_arrow_schema(schema))
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    while wide > FAN_IN:
        leaves = leaves.withColumn(p, F.floor(F.col(p) / FAN_IN)).groupBy(*keys, p).applyInArrow(merger, schema)
        wide //= FAN_IN
    return leaves.groupBy(*keys).applyInArrow(merger, schema).drop(p)


def combine(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary a group from those of several loads, e.g. of the days so far (a union of stored results)."""
    _check_keys(keys)
    ship_package(summaries.sparkSession)
    (p,) = fresh(summaries.columns, "part")
    rows = summaries.select(*keys, F.lit(0).cast("long").alias(p), *[f.name for f in FIELDS])
    schema = T.StructType([*[summaries.schema[k] for k in keys], T.StructField(p, T.LongType()), *FIELDS])
    return rows.groupBy(*keys).applyInArrow(_merged(keys, p, to_arrow_schema(schema)), schema).drop(p)


def _off_rank(rank: Column) -> Column:
    return F.zip_with("rank_min", "rank_max", lambda a, b: F.greatest(rank - a, b - rank))


def percentiles(summaries: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Adds to each summary a column of each name with the value at that share of the ranks (0.5 the median)."""
    columns = {}
    for name, share in shares.items():
        rank = F.greatest(F.ceil(F.col("n") * F.lit(share)), F.lit(1))
        off = _off_rank(rank)
        columns[name] = F.get("quantile_values", (F.array_position(off, F.array_min(off)) - 1).cast("int"))
    return summaries.withColumns(columns)
