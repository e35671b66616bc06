"""Latest version of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows without a load time count as older than any other.
OLDEST = "0001-01-01 00:00:00"


def current_rows(df: DataFrame, *columns: str | Column, key: str = "transcript_id", loaded: str = "loaded_at") -> DataFrame:
    """One row per ``key``: ``columns`` of the row with the greatest ``loaded``.

    Only ``key``, ``loaded`` and ``columns`` reach the scan and the shuffle. Rows with a null key are left out, a null
    ``loaded`` counts as the oldest, rows that tie on ``loaded`` are taken to be identical, an empty table gives no rows.
    """
    value = F.struct(*columns)
    oldest = F.lit(OLDEST).cast(df.schema[loaded].dataType)
    picked = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max_by(value, F.coalesce(F.col(loaded), oldest)).alias("__row"))
    return picked.select(key, "__row.*")
