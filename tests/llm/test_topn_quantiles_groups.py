import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceforge.llm import components, quantiles
from spliceforge.llm.topn import top_per_group

SCHEMA = "g string, c int, score double, id long, rank string, extra array<int>"


def brute_top(data, n):
    out = set()
    for key in {(r[0], r[1]) for r in data}:
        mine = [r for r in data if (r[0], r[1]) == key]
        bad = lambda v: v is None or v != v
        mine.sort(key=lambda r: (bad(r[2]), 0 if bad(r[2]) else -r[2], r[3] is None, r[3] or 0))
        out |= {(r[0], r[1], r[3], k + 1) for k, r in enumerate(mine[:n])}
    return out


@pytest.mark.parametrize("n", [1, 3, 50])
@pytest.mark.parametrize("batch", ["7", "10000"])
def test_top_per_group(spark, n, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = random.Random(n)
        data = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([1, 2, None]), r.choice([1.0, 2.0, 2.5, None, float("nan")]), i, "x", [i]) for i in range(400)]
        got = top_per_group(spark.createDataFrame(data, SCHEMA).repartition(5), ["g", "c"], "score", "id", n)
        assert got.columns == ["g", "c", "score", "id", "rank", "extra", "rank_no"]
        assert {(x["g"], x["c"], x["id"], x["rank_no"]) for x in got.collect()} == brute_top(data, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 5, "x", None)] * 4 + [("a", 1, 2.0, None, "x", None)], SCHEMA)
    assert sorted((r["id"], r["rank_no"]) for r in top_per_group(df, ["g"], "score", "id", 3).collect()) == [(5, 1), (5, 2), (5, 3)]
    assert top_per_group(df.limit(0), ["g"], "score", "id", 3).count() == 0
    for bad in ({"rank": "rank"}, {"n": 0}):
        with pytest.raises(ValueError):
            top_per_group(df, ["g"], "score", "id", bad.get("n", 3), bad.get("rank", "rank_no"))


def summary(x):
    x = np.sort(np.asarray(x, float))
    r = np.arange(1, len(x) + 1)
    return x, r, r.copy()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(4, 20))
def test_ranks_stay_within_the_error(parts, tuples):
    sums = [quantiles.compress(summary(p), len(p), tuples) for p in parts]
    n = sum(map(len, parts))
    merged = quantiles.compress(quantiles.merge(sums, [len(p) for p in parts]), n, tuples)
    everything = np.sort(np.concatenate([np.asarray(p, float) for p in parts]))
    error = quantiles.rank_error(merged)
    values, low, high = merged
    for v, lo, hi in zip(values, low, high):  # some place that the value may take lies between its ranks
        first, last = np.searchsorted(everything, v, "left") + 1, np.searchsorted(everything, v, "right")
        assert first <= hi and lo <= last
    for share in (0.1, 0.5, 0.9, 1.0):
        v, want = quantiles.select(merged, n, share), max(1, math.ceil(share * n))
        first, last = np.searchsorted(everything, v, "left") + 1, np.searchsorted(everything, v, "right")
        assert first - error - 1 <= want <= last + error + 1


def test_compression_adds_a_known_error():
    s, n = summary(np.random.default_rng(1).normal(size=100_000)), 100_000
    c = quantiles.compress(s, n)
    assert len(c[0]) <= quantiles.TUPLES + 2 and quantiles.rank_error(c) <= n / (2 * (quantiles.TUPLES - 1)) + 2


@pytest.mark.parametrize("wide", ["4", "200"])
def test_percentiles_of_groups(spark, wide):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", wide)
    try:
        r = np.random.default_rng(3)
        data = [("big", float(v)) for v in r.exponential(size=30_000)] + [("ties", float(v)) for v in r.integers(0, 3, 5000)] + [(None, 1.0), ("one", 7.0), ("none", None), ("none", float("nan")), ("inf", math.inf)]
        df = spark.createDataFrame(data, "quantile_g string, v double").repartition(9)
        sums = quantiles.summarize(df, ["quantile_g"], "v")
        rows = {x["quantile_g"]: x for x in quantiles.percentiles(sums, {"low": 0.1, "mid": 0.5, "high": 0.99}).collect()}
        assert set(rows) == {"big", "ties", None, "one", "inf"} and rows["one"]["mid"] == 7.0 and rows[None]["n"] == 1 and rows["inf"]["mid"] == math.inf
        for g in ("big", "ties"):
            v = np.sort([x for k, x in data if k == g])
            assert rows[g]["n"] == len(v) and rows[g]["rank_error"] <= 0.01 * len(v) + 2
            for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.99)):
                first, last = np.searchsorted(v, rows[g][name], "left") + 1, np.searchsorted(v, rows[g][name], "right")
                assert first - rows[g]["rank_error"] - 1 <= share * len(v) <= last + rows[g]["rank_error"] + 1
        twice = quantiles.combine(sums.unionByName(sums), ["quantile_g"])
        both = {x["quantile_g"]: x for x in quantiles.percentiles(twice, {"mid": 0.5}).collect()}
        assert both["big"]["n"] == 60_000 and abs(both["big"]["mid"] - rows["big"]["mid"]) < 0.05
        with pytest.raises(ValueError):
            quantiles.summarize(df.withColumnRenamed("quantile_g", "n"), ["n"], "v")
        assert quantiles.summarize(df.limit(0), ["quantile_g"], "v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def brute_groups(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=60))
def test_spanning_forest(edges):
    a, b = (np.array(x, np.int64) for x in zip(*edges))
    nodes, roots = components.spanning_forest(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist())) == brute_groups(edges)


def chain(n):
    return [(i, i + 1) for i in range(n)]


@pytest.mark.parametrize("block", [3, 40, 1_000_000])
@pytest.mark.parametrize("kind", ["random", "ascending", "zigzag", "star", "odd"])
def test_connected_groups(spark, block, kind):
    r = random.Random(7)
    order = list(range(120))
    r.shuffle(order)
    edges = {
        "random": [(r.randrange(150), r.randrange(150)) for _ in range(110)], "ascending": chain(120), "zigzag": [(order[i], order[i + 1]) for i in range(119)],
        "star": [(60, i) for i in range(120)], "odd": [(1, 1), (2, None), (None, None), (3, 4), (4, 3), (3, 4), (-9, 3)],
    }[kind]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, node string").repartition(4)
    got = {x["node"]: x["group_id"] for x in components.connected_groups(df, "a", "b", block).collect()}
    assert got == brute_groups(edges)


def test_no_links(spark):
    assert components.connected_groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
