import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spliceforge.functions import intervals as X
from spliceforge.operators.current import current_rows
from spliceforge.operators.depth import depth_profile
from spliceforge.operators.histogram import histogram
from spliceforge.operators.intervals import merge_intervals, overlap_join

SCHEMA = "k string, s long, e long, kind string"


def brute(data):
    out = []
    for k in {r[0] for r in data}:
        iv = sorted((s, e) for key, s, e in data if key == k and k is not None and s is not None and e is not None and s < e)
        periods = []
        for s, e in iv:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", a, b) for a, b in periods] + [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out)


def sample(seed, n=300):
    r = random.Random(seed)
    data = []
    for _ in range(n):
        s = r.randrange(200)
        data.append((r.choice(["hot", "hot", "hot", "b", "c", None]), r.choice([s, s, s, None]), r.choice([s + r.randrange(-2, 9), None, s + 1])))
    return data + data[:20]


@pytest.mark.parametrize("hot_rows", [1_000_000, 20, 1])
def test_periods_and_gaps(spark, hot_rows):
    data = sample(hot_rows)
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA).repartition(5)
    got = merge_intervals(df, ["k"], "s", "e", hot_rows)
    assert got.columns == ["k", "kind", "pos_from", "pos_to"]
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merge_intervals(df, ["k"], "s", "e").count() == 0
    with pytest.raises(ValueError):
        merge_intervals(df, ["kind"], "s", "e")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 30)), max_size=25), st.sampled_from([1, 1000]))
def test_periods_by_property(spark, data, hot_rows):
    df = spark.createDataFrame(data, "k string, s long, e long")
    assert sorted(map(tuple, merge_intervals(df, ["k"], "s", "e", hot_rows).collect())) == brute(data)


def test_overlap_join_equals_nested_loops(spark):
    r = random.Random(3)
    left = [(i, r.choice("ab"), s := r.randrange(300), s + r.randrange(0, 60)) for i in range(80)]
    right = [(i, r.choice(["a", "b", None]), s := r.randrange(300), s + r.randrange(0, 60)) for i in range(80)]
    a, b = spark.createDataFrame(left, "i int, c string, s int, e int"), spark.createDataFrame(right, "j int, c string, x int, y int")
    got = sorted((r["i"], r["j"]) for r in overlap_join(a, b, ["c"], ("s", "e"), ("x", "y"), 10).collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])


def test_overlap_join_with_itself(spark):
    a = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 5, 15), (3, "c", 15, 20)], "i int, c string, s int, e int")
    got = overlap_join(a, a.withColumnRenamed("i", "j").withColumnsRenamed({"s": "x", "e": "y"}), ["c"], ("s", "e"), ("x", "y"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_depth_over_tiles(spark):
    data = [("c", 0, 10, 2), ("c", 5, 25, 1), ("c", 25, 30, 1), ("c", 40, 40, 9), ("c", 50, 55, None)]
    df = spark.createDataFrame(data, "c string, s int, e int, w int")
    want = [("c", 0, 5, 2), ("c", 5, 10, 3), ("c", 10, 25, 1), ("c", 25, 30, 1)]
    for tile in (7, 1_000_000):
        assert sorted(map(tuple, depth_profile(df, ["c"], "s", "e", "w", tile).collect())) == want


def test_histogram_keeps_empty_bins_and_the_last_edge(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 10.1), ("a", None), ("a", 4.9)], "g string, v double")
    got = {r["bin_no"]: r["count"] for r in histogram(df, F.col("v"), 0, 10, 5, "g").collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}


def test_current_rows(spark):
    data = [(1, "2020-01-01", "old"), (1, "2021-01-01", "new"), (1, "2021-01-01", "new"), (2, None, "only"), (None, "2021-01-01", "x"), (3, None, "null time"), (3, "1999-01-01", "timed")]
    df = spark.createDataFrame(data, "id int, t string, v string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(map(tuple, current_rows(df, "v", key="id", loaded="t").collect())) == [(1, "new"), (2, "only"), (3, "timed")]


def test_chain_expressions(spark):
    exons = F.from_json(F.lit('[{"start":10,"end":20},{"start":30,"end":40},{"start":50,"end":60}]'), "array<struct<start:long,end:long>>")
    lit = F.lit
    row = spark.range(1).select(
        X.chain_text(exons).alias("chain"), X.exonic_length(exons).alias("length"),
        X.to_transcript_position(exons, lit("+"), lit(35)).alias("plus"), X.to_transcript_position(exons, lit("-"), lit(35)).alias("minus"), X.to_transcript_position(exons, lit("+"), lit(25)).alias("none"),
        X.to_genomic_position(exons, lit("+"), lit(15)).alias("g_plus"), X.to_genomic_position(exons, lit("-"), lit(15)).alias("g_minus"), X.to_genomic_position(exons, lit("+"), lit(31)).alias("g_none"),
        X.coding_lengths(exons, lit(15), lit(55), lit("-")).alias("cds"), X.overlap_length(lit(1), lit(5), lit(4), lit(9)).alias("ol"), X.interval_distance(lit(1), lit(5), lit(8), lit(9)).alias("dist"),
        X.compare_positions(lit(10), lit(12)).alias("near"), X.compare_positions(lit(10), lit(14)).alias("far"), X.splice_identical(exons, exons).alias("same"),
    ).first()
    assert (row["chain"], row["length"]) == ("20-30,40-50", 30)
    assert (row["plus"], row["minus"], row["none"]) == (15, 15, None)
    assert (row["g_plus"], row["g_minus"], row["g_none"]) == (35, 35, None)
    assert tuple(row["cds"]) == (5, 20, 5)
    assert (row["ol"], row["dist"], row["near"], row["far"], row["same"]) == (1, 3, 0, -1, True)
