import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceforge.llm import fmindex, mixing, spans
from spliceforge.llm.tokenize import TOKENIZER, TOKENIZER_DIR, count_tokens, encode_texts, encoder, steps

LETTERS = "  \n\t\r 　 'srtvmld!?.,-<|endoftext|>0129abzqé日本ß\U0001f600́\x1c\x85"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/{TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(n=3000):
    r = random.Random(2)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(60))) for _ in range(n)] + ["", None, "<|endoftext|>", "a" * 5000, "\n" * 300 + "x", "''s 's's", "word " * 4000]


def test_ids_equal_the_plain_tokenizer(plain):
    e, texts = encoder(TOKENIZER_DIR, TOKENIZER), odd_texts()
    want = plain(texts)
    assert e.encode(pa.array(texts)).to_pylist() == want
    assert e.count(pa.array(texts)).tolist() == [len(x) for x in want]
    assert e.encode(pa.array(texts).slice(5, 20)).to_pylist() == want[5:25]
    assert e.encode(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_by_property(text):
    e = encoder(TOKENIZER_DIR, TOKENIZER)
    assert e.encode(pa.array([text])).to_pylist() == [e.bpe.encode_ordinary(text)]
    assert e.bpe.decode(e.encode(pa.array([text])).to_pylist()[0]) == text


def test_steps_bound_the_bytes():
    texts = pa.array(["x" * (3 << 20), "y", None, "z" * (5 << 20), "w"])
    got = list(steps(texts))
    assert [i for a, b in got for i in range(a, b)] == list(range(5)) and all(b - a == 1 or sum(len(t or "") for t in texts[a:b].to_pylist()) <= 4 << 20 for a, b in got)


def test_frames(spark, plain):
    texts = odd_texts(200)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, extra string").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in encode_texts(df).collect()}
    want = plain(texts)
    assert got == dict(enumerate(want))
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, keep=["doc_id"]).collect()} == {i: len(x) for i, x in enumerate(want)}
    assert encode_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode_texts(df.withColumnRenamed("extra", "ids"))


# ------------------------------------------------------------------ mixing
def test_plans():
    t = {"a": 1000, "b": 100, "c": 10, "empty": 0}
    p = mixing.plan_mix(t, dict.fromkeys(t, 3), {"a": 0.5, "b": 0.3, "c": 0.01, "empty": 0.19})
    assert p.exponent == 1 and p.sources == ["a", "b", "c"] and sum(p.weights) == pytest.approx(1) and p.weights[0] / p.weights[1] == pytest.approx(5 / 3)
    assert max(b / (3 * t[s]) for b, s in zip(p.budgets, p.sources)) == pytest.approx(1, abs=0.01)
    more = mixing.plan_mix(t, dict.fromkeys(t, 3), {"a": 0.5, "b": 0.3, "c": 0.01}, total=1500)
    assert 0 < more.exponent < 1 and sum(more.budgets) == pytest.approx(1500, abs=3) and all(b <= 3 * t[s] for b, s in zip(more.budgets, more.sources))
    flat = mixing.plan_mix(t, dict.fromkeys(t, 100), target_entropy=0.9)
    assert mixing.entropy(flat.weights) == pytest.approx(0.9, abs=1e-6) and 0 < flat.exponent < 1
    even = mixing.plan_mix(t, dict.fromkeys(t, 10**6))
    assert even.weights == pytest.approx([1 / 3] * 3)
    assert mixing.plan_mix({}, {}, {}).budgets == []


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    r = random.Random(4)
    data = [(s, i * 10 + k, r.choice([0, 1, 5, 9])) for k, (s, n) in enumerate({"a": 900, "b": 300, "c": 40, None: 20, "other": 30}.items()) for i in range(n)]
    df = spark.createDataFrame(data, "source string, record_id long, n_tokens long")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("gone", 0.1, 2), (None, 0.5, 9), ("other", 0.0, 1)], "source string, target_weight double, max_repeats int")
    mix, report = mixing.mix_sources(df, goal)
    uses = mix.collect()
    size, of = {i: n for _, i, n in data}, {i: s for s, i, _ in data}
    limit = {"a": 1, "b": 2, "c": 3}
    times = {}
    for u in uses:
        assert of[u["record_id"]] == u["source"] and size[u["record_id"]] == u["n_tokens"] > 0
        times.setdefault(u["record_id"], []).append(u["pass_no"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= limit[of[i]] for i, p in times.items())
    rows = {x["source"]: x for x in report.collect()}
    assert set(rows) == {"a", "b", "c", "gone", "other", None} and rows["gone"]["reached_tokens"] == rows[None]["reached_tokens"] == rows["other"]["reached_tokens"] == 0
    total = sum(u["n_tokens"] for u in uses)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        mine = sum(u["n_tokens"] for u in uses if u["source"] == s)
        assert rows[s]["reached_tokens"] == mine and rows[s]["budget_tokens"] - 9 <= mine <= rows[s]["budget_tokens"]
        assert mine / total == pytest.approx(w / 0.9, abs=0.02) and rows[s]["reached_share"] == pytest.approx(mine / total)
    assert sorted(map(tuple, mixing.mix_sources(df, goal)[0].collect())) == sorted(map(tuple, uses))
    none, report = mixing.mix_sources(df.limit(0), goal)
    assert none.count() == 0 and report.count() == 4


@pytest.mark.parametrize("how", ["targets", "full_size", "by_entropy"])
def test_exponents_against_a_grid(spark, how):
    """The exponent is the greatest of a fine grid at which the limit of use (or the entropy) holds, and the mixture keeps the plan."""
    have, limit, want = {"a": 900, "b": 300, "c": 40}, {"a": 1, "b": 2, "c": 3}, {"a": 0.3, "b": 0.5, "c": 0.2}
    data = [(s, 10 * i + k, 3) for k, (s, n) in enumerate(have.items()) for i in range(n)]
    df = spark.createDataFrame(data, "source string, record_id long, n_tokens long")
    goal = spark.createDataFrame([(s, want[s], limit[s]) for s in have], "source string, target_weight double, max_repeats int")
    mix, report = mixing.mix_sources(df, goal, full_size=how == "full_size", by_entropy=how == "by_entropy")
    rows = {r["source"]: r for r in report.collect()}
    whole, grid = sum(have.values()) * 3, np.linspace(0, 1, 20_001)
    share = np.array([have[s] * 3 / whole for s in have])
    target, most = np.array([want[s] for s in have]), np.array([have[s] * 3 * limit[s] for s in have])
    toward = np.exp(np.outer(1 - grid, np.log(share)) + np.outer(grid, np.log(target)))
    toward /= toward.sum(1, keepdims=True)
    own = share[None, :] ** grid[:, None]
    own /= own.sum(1, keepdims=True)
    holds = {"targets": grid <= 1, "full_size": (most / toward).min(1) >= whole, "by_entropy": -(own * np.log(own)).sum(1) >= mixing.entropy(list(target))}[how]
    best = grid[np.flatnonzero(holds)[-1]]
    assert rows["a"]["exponent"] == pytest.approx(best, abs=1e-4)
    assert how == "targets" or 0 < best < 1
    weights = (own if how == "by_entropy" else toward)[np.flatnonzero(holds)[-1]]
    assert [rows[s]["planned_share"] for s in have] == pytest.approx(weights.tolist(), abs=1e-3)
    uses = mix.groupBy("source", "record_id").count().groupBy("source").agg({"count": "max"}).collect()
    assert all(u[1] <= limit[u[0]] for u in uses)
    assert all(0 <= rows[s]["budget_tokens"] - rows[s]["reached_tokens"] < 3 and rows[s]["reached_share"] == pytest.approx(w, abs=0.01) for s, w in zip(have, weights))


# ------------------------------------------------------------------ spans
def brute_spans(docs, width):
    owner, many = {}, set()
    for i, t in docs:
        if i is None or t is None:
            continue
        for k in range(len(t) - width + 1):
            if owner.setdefault(t[k : k + width], i) != i:
                many.add(t[k : k + width])
    out = set()
    for i in {i for i, _ in docs if i is not None}:
        for t in {t for j, t in docs if j == i and t is not None}:
            hit = [k for k in range(len(t) - width + 1) if t[k : k + width] in many]
            runs = []
            for k in hit:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + width
                else:
                    runs.append([k, k + width])
            out |= {(i, a, b) for a, b in runs}
    return out


def corpus(seed, alphabet, n=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    pieces = [text(r.choice([79, 80, 81, 120, 300])) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [r.choice([text(r.randrange(0, 90)), r.choice(pieces), r.choice(pieces)[: r.randrange(60, 120)], r.choice(pieces)[r.randrange(0, 40) :]]) for _ in range(r.randrange(1, 5))]
        docs.append((i, "".join(parts)))
    return docs + [(100, "-" * 200), (101, "x" + "-" * 90), (102, docs[0][1]), (103, None), (104, ""), (105, "ab" * 70), (106, "ab" * 45), (None, docs[1][1])]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé日\U0001f600 \n"])
@pytest.mark.parametrize("part,flush", [(1 << 18, 1 << 21), (128, 400)])
def test_shared_spans(spark, monkeypatch, alphabet, part, flush):
    docs = corpus(len(alphabet), alphabet)
    found = shard_by_shard(monkeypatch, docs, part, flush, np.zeros(0, np.uint64), 3)
    assert found == brute_spans(docs, spans.WIDTH)


def test_hot_anchors_change_nothing(monkeypatch):
    docs = corpus(5, "abcd ")
    packer = spans.Packer(1, np.zeros(0, np.uint64))
    list(packer.parts(np.arange(len(docs)), [t for _, t in docs if t]))
    hot = np.unique(packer.held[0][4])[::2]
    assert shard_by_shard(monkeypatch, docs, 1 << 18, 1 << 21, hot, 5) == brute_spans(docs, spans.WIDTH)


def shard_by_shard(monkeypatch, docs, part, flush, hot, n_shards):
    monkeypatch.setattr(spans, "PART", part)
    kept = [(i, t) for i, t in docs if i is not None and t is not None]
    batch = pa.RecordBatch.from_pydict({"i": [i for i, _ in kept], "t": [t for _, t in kept]})
    packer, blobs, occurrences = spans.Packer(n_shards, hot), {}, {}

    def empty():
        for shard, number, blob, whole in packer.flush():
            if whole:
                occurrences[number] = blob
            else:
                blobs.setdefault(shard, []).append((number, blob))

    for ids, texts in spans._grouped([batch]):
        for _ in packer.parts(ids, texts):
            if packer.size >= flush:
                empty()
    empty()
    found = [spans.shared_in_shard(*zip(*b)) for b in blobs.values()]
    of, number, a, e = (np.concatenate(x) for x in zip(*found))
    stretches = {}
    for k, blob in occurrences.items():
        mine = of == k
        for i, x, y in zip(*(x.tolist() for x in spans.runs_of_flush(blob, number[mine], a[mine], e[mine]))):
            stretches.setdefault(i, []).append((x, y))
    out = set()
    for i, iv in stretches.items():
        runs = []
        for x, y in sorted(iv):
            if runs and x <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], y)
            else:
                runs.append([x, y])
        out |= {(i, x, y) for x, y in runs}
    return out


def test_every_stretch_comes_from_the_search(monkeypatch):
    docs, windows, asked = corpus(6, "abcdef "), [], []
    real = fmindex.FMIndex.matching_statistics

    def counted(self, queries, lengths, text):
        asked.append((lengths - spans.WIDTH + 1).sum())
        for live, at, length, shared in real(self, queries, lengths, text):
            windows.append(int(shared.sum()))
            yield live, at, length, shared

    monkeypatch.setattr(fmindex.FMIndex, "matching_statistics", counted)
    assert shard_by_shard(monkeypatch, docs, 1 << 18, 1 << 21, np.zeros(0, np.uint64), 3) == brute_spans(docs, spans.WIDTH)
    assert 0 < sum(windows) <= sum(asked)
    monkeypatch.setattr(fmindex.FMIndex, "matching_statistics", lambda *a: iter(()))
    assert not shard_by_shard(monkeypatch, docs, 1 << 18, 1 << 21, np.zeros(0, np.uint64), 3)


def test_copies_reach_a_shard_once_a_flush():
    packer = spans.Packer(1, np.zeros(0, np.uint64))
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    list(packer.parts(np.arange(500), [text] * 500))
    one, many = spans.Packer(1, np.zeros(0, np.uint64)), [b for _, _, b, whole in packer.flush() if not whole]
    list(one.parts(np.arange(1), [text]))
    single = [b for _, _, b, whole in one.flush() if not whole]
    assert len(spans.unpack(many[0], spans.CONTEXT)[0][0]) == len(spans.unpack(single[0], spans.CONTEXT)[0][0])


def test_shared_spans_of_frames(spark):
    docs = corpus(9, "abcdef ")
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, span_from string").repartition(4)
    assert {tuple(r) for r in spans.shared_spans(df, "doc_id", "text").collect()} == brute_spans(docs, spans.WIDTH)
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_hot_anchors_of_frames(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_CONTEXTS", 4)
    monkeypatch.setattr(spans, "HOT_HITS", 3)
    docs = corpus(11, "abcdef ")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert spans._hot_anchors(df.where("doc_id is not null and text is not null"))
    assert {tuple(r) for r in spans.shared_spans(df, "doc_id", "text").collect()} == brute_spans(docs, spans.WIDTH)


def test_matching_statistics():
    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(8, 30))) for _ in range(40)]
    text = np.concatenate([np.array([ord(c) - 96 for c in t] + [0]) for t in texts])
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    record = np.array([r.randrange(25) for _ in texts])
    most = np.maximum(record, [r.choice([0, 30]) for _ in texts])  # some texts are of several records themselves
    index = fmindex.FMIndex(text, 4, 8, np.repeat(record, lengths + 1), np.repeat(most, lengths + 1))
    has = lambda g: {x for t, lo, hi in zip(texts, record, most) if g in t for x in (lo, hi)}
    seen = 0
    for live, at, length, shared in index.matching_statistics(begins, lengths, text):
        for q, a, hit in zip(live.tolist(), at.tolist(), shared.tolist()):
            assert length == min(8, lengths[q] - a) and hit == (length == 8 and len(has(texts[q][a : a + 8])) > 1)
            seen += 1
    assert seen == lengths.sum()
    w = fmindex.WaveletMatrix(text, 4)
    for s in range(4):
        at = np.arange(len(text) + 1)
        assert w.counts(np.full(len(at), s), at).tolist() == np.concatenate([[0], np.cumsum(text == s)]).tolist()


def test_the_index_is_compressed():
    text = np.random.default_rng(1).integers(1, 100, 1 << 16)
    text[99::100] = 0
    owner = np.arange(len(text)) // 100
    index = fmindex.FMIndex(text, 100, 80, owner, owner)
    assert index.nbytes() < 2 * len(text)  # seven levels and two bits a row, with counts
    assert not any(isinstance(v, np.ndarray) and len(v) >= len(text) for v in vars(index).values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=300))
def test_bit_vectors(bits):
    bits[0] = bits[-1] = True
    v, at = fmindex.BitVector(np.array(bits)), np.arange(len(bits))
    assert v.get(at).tolist() == bits
    assert v.last(at).tolist() == [max(k for k in range(i + 1) if bits[k]) for i in at]
    assert v.next(at).tolist() == [min(k for k in range(i, len(bits)) if bits[k]) for i in at]
