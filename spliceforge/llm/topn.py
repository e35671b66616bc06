"""The N rows with the highest score of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spliceforge.llm.runs import RunFinder
from spliceforge.session import fresh, ship_package


def _kernel(keys: list[str], n: int, rank: str | None, keep: list[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, carried = RunFinder(keys), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            new = finder.starts(batch)
            begin = np.maximum.accumulate(np.where(new, at, -carried))
            no = at - begin + 1
            carried = int(no[-1])
            out = batch.select(keep)
            if rank:
                out = out.append_column(rank, pa.array(no, pa.int32()))
            yield out.filter(pa.array(no <= n))

    return emit


def top_per_group(df: DataFrame, groups: list[str], score: str, ident: str, n: int, rank: str = "rank_no") -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``: the columns of ``df`` and ``rank`` (1 to n).

    Secondary sort: rows are sorted by group, score and identifier within partitions and streamed in Arrow batches of which
    the first n rows of a group go on. This is done once in the partitions as they come, so that a group sends at most n
    rows of each to the shuffle however many rows it has, and once after hashing by group.

    Equal scores rank by smaller ``ident``; null and NaN scores and null idents rank last; null group values are a group of
    their own. Rows that tie in both are ranked in the order of a hash of the row's plain columns. An empty table gives no row.
    ``rank`` must not be a column of ``df``.
    """
    if rank.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{rank} is a column already")
    if n < 1:
        raise ValueError("n must be positive")
    ship_package(df.sparkSession)
    h, s, t = fresh(df.columns, "hash", "score", "tie")
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    number = F.nullif(F.col(score), F.lit(float("nan"))) if isinstance(df.schema[score].dataType, T.FractionalType) else F.col(score)
    rows = df.withColumns({h: F.xxhash64(*groups), s: number, t: F.xxhash64(*plain)})
    order = [F.col(h), *[F.col(g) for g in groups], F.col(s).desc_nulls_last(), F.col(ident).asc_nulls_last(), F.col(t)]
    keys = [h, *groups]
    first = rows.sortWithinPartitions(*order).mapInArrow(_kernel(keys, n, None, rows.columns), rows.schema)
    second = first.repartition(h).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField(rank, T.IntegerType())])
    return second.mapInArrow(_kernel(keys, n, rank, df.columns), schema)
