import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spliceforge.operators.packed import packed_integers, packed_slots
from spliceforge.operators.skew import heavy_keys, skew_aggregate, skew_lookup
from spliceforge.operators.strict_load import DOMAINS, SAMPLES, rejected, strict_load


def skewed(spark, n=3000):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.4 else r.choice([f"k{i}" for i in range(200)] + [None]), r.choice([1, 2, 3, None]), r.randrange(50)) for _ in range(n)]
    return data, spark.createDataFrame(data, "k string, v int, d int").repartition(6)


def test_heavy_keys_finds_the_hot_one(spark):
    _, df = skewed(spark)
    assert [r["k"] for r in heavy_keys(df, "k", 0.1).collect()] == ["hot"]
    assert heavy_keys(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("share", [0.1, 0.001])
def test_aggregate_equals_plain_group_by(spark, share):
    data, df = skewed(spark)
    want = {}
    for k in {r[0] for r in data}:
        mine = [r for r in data if r[0] == k]
        vs = [v for _, v, _ in mine if v is not None]
        want[k] = (sum(vs) if vs else None, len({d for *_, d in mine}))
    got = skew_aggregate(df, "k", {"total": "v"}, ("n", "d"), heavy_keys(df, "k", share))
    assert {r["k"]: (r["total"], r["n"]) for r in got.collect()} == want
    assert skew_aggregate(df.limit(0), "k", {"total": "v"}).count() == 0


def test_lookup_equals_plain_join(spark):
    _, df = skewed(spark)
    right = spark.createDataFrame([(f"k{i}", i) for i in range(150)] + [("hot", -1)], "id string, x int")
    for how in ("inner", "left"):
        got = skew_lookup(df, right, "k", "id", heavy_keys(df, "k", 0.1), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.join(right, df.k == right.id, how).collect()))


CASES = {
    "1,2,3": [(1, 1), (2, 2), (3, 3)], "1,2,": [(1, 1), (2, 2)], ",5": [(2, 5)], "1,,3": [(1, 1), (3, 3)], "7": [(1, 7)], "": [], "  ": [], " [1; 2] ": [(1, 1), (2, 2)], "(-1|+2)": [(1, -1), (2, 2)],
    "4 5\t6": [(1, 4), (2, 5), (3, 6)], '"1,234", 5': [(1, 1234), (2, 5)], "'7' '8'": [(1, 7), (2, 8)], '1;"";3': [(1, 1), (3, 3)], "1, NA, 3": [(1, 1), (3, 3)], '"1': [], "99999999999999999999,1": [(2, 1)], "1.5,2": [(2, 2)],
    '0,"5"': [(2, 5)], "{1 ,2 , 3}\n": [(1, 1), (2, 2), (3, 3)], "1,,": [(1, 1)], '" 9 "': [(1, 9)], " 1, 2": [(1, 1), (2, 2)],
}


def brute_slots(text):
    """The slots by reading one character after the other."""
    text = re.sub(r"^[\s\[({<]+", "", text)
    text = re.sub(r"[\s\])}>]+$", "", text)
    slots, now, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c in "\"'" and (k := text.find(c, i + 1)) >= 0:
            now, quoted, i = now + text[i + 1 : k], True, k + 1
        elif m := re.compile(r"\s*[,;|/:\\!?&#*~^_=@%$]\s*|\s+").match(text, i):
            slots.append((now, quoted))
            now, quoted, i = "", False, m.end()
            if i == len(text):
                return slots
        else:
            now, i = now + c, i + 1
    return [*slots, (now, quoted)]


ODD = ['1,a"2,3"x,4', '1,"2"3', '"1""2",3', "'a'\"b\";", '"', "''", "it's, 5", "\ue0000\ue001,1", '"\ue000",\ue001', '"a,b" "c\ue0007\ue001"', "\ue0001\ue001\"x\"", ",", "\u2003", "[ ]", "1 , 2 ,", '"x"]', "1 ) 2)"]


@pytest.mark.parametrize("seed", range(3))
def test_slots_equal_a_reader_of_characters(spark, seed):
    r = random.Random(seed)
    texts = ODD + ["".join(r.choice("12,;  'a\"\ue000\ue001()-") for _ in range(r.randrange(14))) for _ in range(400)]
    got = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", packed_slots(F.col("t")).alias("s")).collect()
    assert {texts[x["i"]]: [tuple(s) for s in x["s"]] for x in got} == {t: brute_slots(t) for t in texts}


def test_the_work_is_in_proportion_to_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(i, ",".join(f'"{k}"' for k in range(n))) for i in range(20)], "id int, t string").repartition(1).cache()
        df.count()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert packed_integers(df, "id", ["t"]).count() == 20 * n
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(4_000) < 8 * seconds(1_000) + 1


def test_packed_integers(spark):
    data = [(i, t, None, "x") for i, t in enumerate(CASES)] + [(0, "1,2,3", None, "y"), (None, "1,2", "3", "z")]
    df = spark.createDataFrame(data, "id int, Sizes string, other string, slot_no string")
    got = defaultdict(list)
    for r in packed_integers(df, "id", ["Sizes", "other"]).collect():
        got[r["id"], r["field_name"]].append((r["slot_no"], r["item"]))
    for i, (text, want) in enumerate(CASES.items()):
        assert sorted(got[i, "sizes"]) == want, text
    assert sorted(got[None, "sizes"]) == [(1, 1), (2, 2)] and got[None, "other"] == [(1, 3)]
    assert packed_integers(df.limit(0), "id", ["Sizes"]).count() == 0


def brute_reason(feed, line):
    """The rules, read one character after the other."""
    if not line.strip() or line.startswith("#"):
        return None
    line = line.removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, value = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                value += line[j:k]
                if line[k + 1 : k + 2] == '"':
                    value, j = value + '"', k + 2
                    continue
                break
            if k + 1 < len(line) and line[k + 1] != "\t":
                return "quoting"
            fields.append(value)
            i = k + 1
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            fields.append(line[i:k])
            i = k
        if i >= len(line):
            break
        i += 1
    if len(fields) != (3 if feed == "sample_table" else 30):
        return "column_count"
    number = lambda t: int(t) if re.fullmatch("[0-9]+", t) and int(t) < 2**31 else None
    if feed == "sample_table":
        ok = len(fields[1]) > 4 and fields[1].endswith(".bam") and not re.search(r"[\s\x00-\x1f\x7f-\x9f]", fields[1])
    else:
        a, b, n = number(fields[2]), number(fields[3]), number(fields[10])
        items = fields[12].removesuffix(",").split(",") if fields[12].removesuffix(",") else []
        ok = None not in (a, b, n) and a < b and len(items) == n and all(number(x) is not None for x in items)
    return None if ok else "invalid_value"


def test_rejected_lines_of_the_table(spark):
    raw = spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet")
    want = {r["record_id"]: w for r in raw.collect() if (w := brute_reason(r["feed"], r["line"]))}
    got = [tuple(r) for r in rejected(raw, [SAMPLES, DOMAINS]).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_rejected_and_loaded_lines(spark):
    lines = [
        'a\tx.bam\tg', 'a\t"x.bam"\t"g ""1"""', 'a\t"x.bam\tg', 'a\t"x"y.bam\tg', "a\tx.bam", "a\t.bam\tg", "a\tx y.bam\tg", "a\tx.BAM\tg", "a\tx.bam\t", '"a\tb"\tx.bam\tg\r', "   ", "# no", "", None, "\tx.bam\t",
        'a\tx.bam\t5" rack', "a\tx .bam\tg", "a\t\u0000.bam\tg",
    ]
    df = spark.createDataFrame([(i, "sample_table", 1, t, "extra") for i, t in enumerate(lines)] + [(0, "sample_table", 1, lines[0], "extra"), (99, "other", 1, "x", "")], "record_id long, feed string, line_no int, line string, __body string")
    want = {i: w for i, t in enumerate(lines) if t is not None and (w := brute_reason("sample_table", t))}
    want[16] = "invalid_value"
    assert dict(map(tuple, rejected(df, [SAMPLES, DOMAINS]).collect())) == want
    loaded = {r["record_id"]: r for r in strict_load(df, SAMPLES).collect()}
    assert set(loaded) == {0, 1, 8, 9, 14, 15}
    assert loaded[1]["sample_group"] == 'g "1"' and loaded[9]["sample_name"] == "a\tb" and loaded[9]["sample_group"] == "g"
    assert rejected(df.limit(0), [SAMPLES]).count() == 0


def test_records_without_an_identifier(spark):
    lines = [(None, "a\tx.bam\tg"), (None, "a\tx.bam\tg"), (None, "b\ty.bam\tg"), (None, "broken"), (None, "c\tz\tg"), (1, "d"), (1, "a\tw.bam\tg")]
    df = spark.createDataFrame([(i, "sample_table", t) for i, t in lines], "record_id long, feed string, line string")
    assert sorted(r["file_name"] for r in strict_load(df, SAMPLES).collect()) == ["w.bam", "x.bam", "y.bam"]
    assert sorted((str(r["record_id"]), r["reason"]) for r in rejected(df, [SAMPLES]).collect()) == [("None", "column_count"), ("None", "invalid_value")]
