"""Mixing of sources to target weights, with a limit on how often a record is used."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceforge.session import materialize

#: Records a block of a source holds on average; the last, partial pass over a source ends inside one block.
BLOCK_ROWS = 20_000
MIN_BLOCKS = 64


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float, toward: list[float] | None = None) -> list[float]:
    """Normalised ``shares`` to the power ``exponent``; with ``toward``, shares^(1 - exponent) * toward^exponent."""
    logs = [exponent * math.log(s) if toward is None else (1 - exponent) * math.log(s) + exponent * math.log(t) for s, t in zip(shares, toward or shares)]
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def bisect(holds, low: float, high: float, steps: int = 200) -> float:
    """The greatest value up to ``high`` at which ``holds``, given that it holds from ``low`` up to some point."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


@dataclass(frozen=True)
class Plan:
    """Weights and token budgets of the sources that have tokens; ``exponent`` is 1 where the targets are met as they are."""

    sources: list[str]
    weights: list[float]
    budgets: list[int]
    exponent: float


def plan_mix(tokens: dict[str, int], repeats: dict[str, int], targets: dict[str, float] | None = None, total: int | None = None, target_entropy: float | None = None) -> Plan:
    """Budgets such that no source is used more than its ``repeats`` times.

    With ``targets``, weights go from the sources' own token shares (exponent 0) to the targets (1), renormalised over the
    sources with tokens; without, they are the shares to the exponent that gives ``target_entropy`` (0 makes all equal). The
    total is by default the greatest at which these weights keep the limit. For a greater ``total`` the exponent is bisected
    down to where the limit holds (with ``targets``), and where not even the own shares keep it, the total is lowered.
    """
    names = sorted(s for s, n in tokens.items() if n > 0 and repeats.get(s, 0) > 0 and (targets is None or targets.get(s, 0) > 0))
    if not names:
        return Plan([], [], [], 1.0)
    every = sum(tokens[s] for s in names)
    shares, most = [tokens[s] / every for s in names], [tokens[s] * repeats[s] for s in names]
    room = lambda w: min(m / x for m, x in zip(most, w))
    if targets is None:
        goal = math.log(len(names)) if target_entropy is None else target_entropy
        exponent = bisect(lambda a: entropy(tempered(shares, a)) >= goal, 0.0, 64.0)
        weights = tempered(shares, exponent)
    else:
        toward = [targets[s] for s in names]
        exponent, weights = 1.0, tempered(shares, 1.0, toward)
        if total is not None and total > room(weights):
            exponent = bisect(lambda a: room(tempered(shares, a, toward)) >= total, 0.0, 1.0)
            weights = tempered(shares, exponent, toward)
    size = room(weights) if total is None else min(total, room(weights))
    return Plan(names, weights, [min(m, math.floor(size * w + 1e-6)) for m, w in zip(most, weights)], exponent)


def source_totals(counted: DataFrame) -> DataFrame:
    """source, tokens, n_records."""
    return counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_records"))


def realise(counted: DataFrame, plan: Plan, totals: dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """source, record_id, pass_no (from 1), n_tokens, mix_order: one row for each use of a record.

    ``counted`` has source, record_id, n_tokens. A source's records fall into blocks by a hash of the identifier, a random
    permutation that stays the same at every run. As many whole passes are made as the budget holds; of one more pass the
    blocks are taken that fit whole, and of the next block the records that fit, in the order of the hash. Only that one
    block a source is ever sorted. The sum never exceeds a budget; ordering the result by mix_order gives the mixture.
    """
    spark = counted.sparkSession
    rows = []
    for s, budget in zip(plan.sources, plan.budgets):
        tokens, n = totals[s]
        rows.append((s, budget // tokens, budget % tokens, max(MIN_BLOCKS, n // BLOCK_ROWS)))
    per_source = F.broadcast(spark.createDataFrame(rows, "source string, passes long, rest long, n_blocks long"))  # a row a source of the plan
    key = F.xxhash64("record_id", F.lit(seed))
    docs = counted.where("n_tokens > 0").join(per_source, "source").withColumn("key", key).withColumn("block", F.pmod("key", "n_blocks"))
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(upto), F.lit(0)))
    blocks = blocks.withColumn("state", F.when(F.col("before") + F.col("in_block") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    placed = docs.join(blocks.select("source", "block", "before", "state"), ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("key", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("state = 1").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    edge = edge.select("source", "record_id", "n_tokens", "passes", (F.col("upto") <= F.col("rest")).cast("long").alias("more"))
    bulk = placed.where("state != 1").select("source", "record_id", "n_tokens", "passes", (F.col("state") / 2).cast("long").alias("more"))
    used = bulk.unionByName(edge).withColumn("times", F.col("passes") + F.col("more")).where("times > 0")
    uses = used.select("source", "record_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass_no"), "n_tokens")
    return uses.withColumn("mix_order", F.xxhash64("pass_no", "record_id", F.lit(seed + 1)))


def mix_sources(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, full_size: bool = False, by_entropy: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mixture (see :func:`realise`) and a report of the shares reached, a row for each source of either table.

    ``counted``: source, record_id (unique), n_tokens. ``targets``: source, target_weight, max_repeats, a small table that
    the driver reads; repeated or null sources, weights that are null or not positive and limits under 1 are left out of the
    plan. Records without tokens or whose source is null or has no target are never used; a target without records reaches
    nothing, and the others' weights are kept in proportion. Empty tables give an empty mixture.

    ``full_size`` asks for as many tokens as the sources of the plan have, whatever exponent that takes; ``by_entropy`` tempers the
    sources' own token shares to the entropy of the target weights instead of going towards the targets. The exponent is reported.
    """
    counted = materialize(counted, "token-counts")
    goal = {r["source"]: r for r in targets.collect() if r["source"] is not None and (r["target_weight"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    known = counted.where(F.col("source").isin(list(goal)))
    totals = {r["source"]: (r["tokens"], r["n_records"]) for r in source_totals(known).collect()}
    tokens, repeats = {s: t for s, (t, _) in totals.items()}, {s: r["max_repeats"] for s, r in goal.items()}
    size = sum(tokens.values()) if full_size else total
    if by_entropy:
        weights = [r["target_weight"] for s, r in goal.items() if tokens.get(s)]
        plan = plan_mix(tokens, repeats, total=size, target_entropy=entropy([w / sum(weights) for w in weights]))
    else:
        plan = plan_mix(tokens, repeats, {s: r["target_weight"] for s, r in goal.items()}, size)
    mixture = realise(counted, plan, totals, seed)
    reached = mixture.groupBy("source").agg(F.sum("n_tokens").alias("reached_tokens"), F.max("pass_no").alias("most_uses"), F.count(F.lit(1)).alias("n_uses"))
    rows = list(zip(plan.sources, plan.weights, plan.budgets))
    planned = spark_rows(counted, rows, "source string, planned_share double, budget_tokens long")
    wanted = spark_rows(counted, [(s, r["target_weight"], r["max_repeats"]) for s, r in goal.items()], "source string, target_weight double, max_repeats int")
    report = source_totals(counted).withColumnRenamed("tokens", "available_tokens").withColumnRenamed("n_records", "available_records")
    report = report.join(wanted, "source", "full").join(planned, "source", "left").join(reached, "source", "left")
    report = report.na.fill(0, ["available_tokens", "available_records", "planned_share", "budget_tokens", "reached_tokens", "most_uses", "n_uses"])
    share = F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0))  # a row a source
    return mixture, report.withColumns({"reached_share": F.coalesce(share, F.lit(0.0)), "exponent": F.lit(plan.exponent)})


def spark_rows(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)
