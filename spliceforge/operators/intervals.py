"""Interval algebra: union into periods, gaps, and the binned overlap join. All intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.operators.ranks import row_numbers
from spliceforge.session import materialize


def sorted_bounds(exons: Column, start: str, end: str) -> tuple[Column, Column]:
    """Starts and ends of the valid intervals of an array column, each sorted on its own.

    Elements that are null, have a null bound or end at or before their start are left out; a null array stays null.
    Keep both as columns of a projection before passing them on, so that they are sorted once a row.
    """
    valid = F.filter(exons, lambda x: x[start] < x[end])
    return (
        F.sort_array(valid[start].cast("array<long>")),
        F.sort_array(valid[end].cast("array<long>")),
    )


def period_bounds(starts: Column, ends: Column) -> tuple[Column, Column]:
    """Starts and ends of the periods, from independently sorted bounds.

    A gap lies after the k-th end where the start ranked next exceeds it; the start after a gap opens a period and the end
    before one closes it, so the k-th remaining start belongs to the k-th remaining end. Touching intervals share a period.
    """
    opens = F.filter(starts, lambda s, i: F.coalesce(s > F.get(ends, i - 1), F.lit(True)))
    closes = F.filter(ends, lambda e, i: F.coalesce(F.get(starts, i + 1) > e, F.lit(True)))
    return opens, closes


def periods_and_gaps(opens: Column, closes: Column) -> Column:
    """array<struct<kind, pos_from, pos_to>> of the periods and of the gaps between neighbouring ones."""

    def pieces(kind: str, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(F.lit(kind).alias("kind"), x.alias("pos_from"), y.alias("pos_to")))

    n = F.size(opens)
    tail, head = F.slice(opens, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(closes, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.concat(pieces("period", opens, closes), pieces("gap", head, tail))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Periods and gaps of each entity: ``keys``, kind (``period`` or ``gap``), pos_from, pos_to (int64).

    Entities of up to ``hot_rows`` rows are merged in one array each. Larger ones never reach one task: their starts and ends are
    ranked over range partitions, with an offset per partition, and compared by joins on the rank. The list of larger entities has at most rows / ``hot_rows`` rows. With None, for
    entities of known bounded size, none is looked for.

    Rows with a null key or bound, or whose end isn't greater than the start, are left out; an entity without a valid row
    gives no row, repeated rows and ties change nothing, extra columns aren't read.
    """
    if {"kind", "pos_from", "pos_to"} & {k.lower() for k in keys}:
        raise ValueError("a key can't be named kind, pos_from or pos_to")
    k = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"))
    base = base.where("__s < __e").dropna(subset=k)
    hot = None if hot_rows is None else base.groupBy(*k).count().where(F.col("count") > hot_rows).select(*k)
    if hot is None or hot.isEmpty():
        merged = _merge_small(base, k)
    else:
        hot = materialize(hot, "hot-entities")
        merged = _merge_small(base.join(hot, k, "left_anti"), k).unionByName(_merge_hot(base.join(F.broadcast(hot), k), k))
    return merged.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "kind", "pos_from", "pos_to")


def _merge_small(base: DataFrame, k: list[str]) -> DataFrame:
    bounds = base.groupBy(*k).agg(F.sort_array(F.collect_list("__s")).alias("__s"), F.sort_array(F.collect_list("__e")).alias("__e"))
    opens, closes = period_bounds(F.col("__s"), F.col("__e"))
    periods = bounds.select(*k, opens.alias("__o"), closes.alias("__c"))
    return periods.select(*k, F.inline(periods_and_gaps(F.col("__o"), F.col("__c"))))


def _merge_hot(base: DataFrame, k: list[str]) -> DataFrame:
    """The same by ranks over ranges: starts and ends are numbered on their own, and the start ranked next meets the end by its rank."""
    rows = base.distinct()
    starts = row_numbers(rows.select(*k, "__s"), k, ["__s"], "__r")
    ends = row_numbers(rows.select(*k, "__e"), k, ["__e"], "__r").withColumn("__r", F.col("__r") + 1)
    edges = materialize(starts.join(ends, [*k, "__r"], "full").where("__s is null or __e is null or __s > __e").select(*k, "__s", "__e"), "interval-edges")
    opens = row_numbers(edges.where("__s is not null").select(*k, F.col("__s").alias("pos_from")), k, ["pos_from"], "__r")
    closes = row_numbers(edges.where("__e is not null").select(*k, F.col("__e").alias("pos_to")), k, ["pos_to"], "__r")
    periods = opens.join(closes, [*k, "__r"]).select(*k, F.lit("period").alias("kind"), "pos_from", "pos_to")
    gaps = edges.where("__s > __e").select(*k, F.lit("gap").alias("kind"), F.col("__e").alias("pos_from"), F.col("__s").alias("pos_to"))
    return periods.unionByName(gaps)


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], l_span: tuple[str, str], r_span: tuple[str, str], bin_width: int = 10_000) -> DataFrame:
    """Inner join of rows that agree on ``on`` and whose half-open spans overlap by a base or more.

    Equi-join on (``on``, bin) with a residual predicate; a pair is kept only in the later of the two first bins, which
    makes it unique without a distinct. The result has ``on`` once, then the other columns of both sides, whose names must
    differ. Null keys or bounds match nothing, empty spans match nothing, repeated rows give repeated pairs.
    """
    # names of their own on either side, so that both may come from one frame
    left_names, right_names = {c: f"__l{i}" for i, c in enumerate(left.columns)}, {c: f"__r{i}" for i, c in enumerate(right.columns)}

    def side(df: DataFrame, names: dict[str, str], span: tuple[str, str], b: str) -> DataFrame:
        s, e = (F.col(names[c]) for c in span)
        rows = df.select(*[F.col(c).alias(a) for c, a in names.items()]).where(s < e)
        return rows.withColumn(b, F.explode(F.sequence(F.floor(s / bin_width), F.floor((e - 1) / bin_width))))

    ls, le, rs, re = (F.col(n[c]) for n, span in ((left_names, l_span), (right_names, r_span)) for c in span)
    cond = (F.col("__lbin") == F.col("__rbin")) & (ls < re) & (rs < le) & (F.col("__lbin") == F.greatest(F.floor(ls / bin_width), F.floor(rs / bin_width)))
    for c in on:
        cond = cond & (F.col(left_names[c]) == F.col(right_names[c]))
    joined = side(left, left_names, l_span, "__lbin").join(side(right, right_names, r_span, "__rbin"), cond)
    return joined.select(*[F.col(a).alias(c) for c, a in left_names.items()], *[F.col(a).alias(c) for c, a in right_names.items() if c not in on])
