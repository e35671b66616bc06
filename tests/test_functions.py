import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spliceforge.functions import cigar as C
from spliceforge.functions import sequence as S
from spliceforge.functions import stats
from spliceforge.functions.filters import FilterError, Filters, default_filters, tag_name
from spliceforge.operators import collapse
from spliceforge.operators.domains import contained, domain_blocks, hits_on_genome, label_sets
from spliceforge.operators.ends import prominent_peaks, smooth, unify_ends
from spliceforge.sources.alignments import quality_histogram

EXONS = "array<struct<start:long,end:long>>"


def test_cigar(spark):
    df = spark.createDataFrame([("5S10M5N3M2D4M3S", 100), ("3H4M2I4M", 7), ("10M5N", 0), ("*", 3), (None, 3)], "c string, p int")
    ops = C.cigar_ops(F.col("c"))
    out = df.select(C.exons_of(ops, F.col("p")).alias("x"), C.aligned_part(ops, F.lit(False)).alias("f"), C.aligned_part(ops, F.lit(True)).alias("r"), C.clipping(ops, F.col("p"), F.lit(200)).alias("k")).collect()
    assert [tuple(e) for e in out[0]["x"]] == [(100, 110), (115, 124)]
    assert tuple(out[0]["f"]) == (5, 22) and tuple(out[0]["r"]) == (3, 20) and tuple(out[0]["k"]) == (100, -5)
    assert [tuple(e) for e in out[1]["x"]] == [(7, 15)] and tuple(out[1]["f"]) == (3, 13) and out[1]["k"] is None
    assert [tuple(e) for e in out[2]["x"]] == [(0, 10)]
    assert out[3]["x"] == [] and out[4]["x"] is None
    rate = spark.range(1).select(C.error_rate(F.array(F.lit(10), F.lit(20))).alias("e"), C.error_rate(F.array().cast("array<int>")).alias("n")).first()
    assert rate["e"] == pytest.approx(0.055) and rate["n"] is None


def test_sequence_columns(spark):
    df = spark.createDataFrame([("ACGTNAAGT",)], "s string")
    exons = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(7).alias("start"), F.lit(9).alias("end")))
    r = df.select(S.reverse_complement(F.col("s")).alias("rc"), S.spliced(F.col("s"), exons, F.lit("+")).alias("p"), S.spliced(F.col("s"), exons, F.lit("-")).alias("m"), S.splice_motif(F.col("s"), F.lit(2), F.lit(7), F.lit("+")).alias("g"), S.translate_udf(F.lit("ATGTAA")).alias("t")).first()
    assert (r["rc"], r["p"], r["m"], r["g"], r["t"]) == ("ACTTNACGT", "ACGT", "ACGT", "GTAA", "M*")


def test_open_frames_against_a_plain_scan():
    r = random.Random(5)
    for _ in range(200):
        seq = "".join(r.choice("ACGT") for _ in range(120))
        for a, b, f, n in S.open_frames(seq):
            assert seq[a : a + 3] == "ATG" and a % 3 == f and n == sum(seq[i : i + 3] == "ATG" for i in range(a))
            stop = next((i for i in range(a, 118, 3) if seq[i : i + 3] in S.STOPS), None)
            assert b == (a if stop is None else stop + 3)
    assert S.best_frame("CCATGAAATAA", 3) == (2, 11, 0) and S.best_frame("CCC") is None
    assert S.decays(40, [100, 50]) and not S.decays(60, [100, 50]) and not S.decays(10, [100])
    assert S.kozak_score("AAGATGG", 3, {-1: {"G": 1.5}, 3: {"G": 2.0}, -9: {"A": 7.0}}) == 3.5


def test_coding_scores(spark):
    assert S.testcode("") is None and 0 < S.testcode("ATGGCA" * 40) < 2
    assert S.testcode("ACGT" * 60) < S.testcode("ATGGCTGAAGCTGAC" * 16)
    table = {"ATGGCA": (0.4, 0.1), "GCAATG": (0.0, 0.2)}
    assert S.hexamer_score("ATGGCAATG", table) == pytest.approx((math.log(4) - 1) / 2) and S.hexamer_score("CCC", table) is None


def test_shifted_junctions(spark):
    rows = spark.createDataFrame([(1, [(0, 10), (20, 30), (40, 50)]), (2, [(0, 5), (9, 12)])], f"transcript_id long, exons {EXONS}")
    shifts = spark.createDataFrame([(1, 0, 2), (1, 1, -10)], "transcript_id long, intron_no int, shift long")
    got = {r["transcript_id"]: [tuple(e) for e in r["exons"]] for r in collapse.shift_junctions(rows, shifts).collect()}
    assert got == {1: [(0, 12), (30, 50)], 2: [(0, 5), (9, 12)]}
    assert collapse.without_samples(spark.createDataFrame([(1, "a"), (2, "b")], "i int, sample_name string"), ["a"]).count() == 1


def test_quality_histogram(spark):
    df = spark.createDataFrame([([10] * 5,), ([30] * 50,), ([],)], "q array<int>")
    assert sorted(map(tuple, quality_histogram(df, "q", [1.0, 5.0], [10, 100]).collect())) == [(0, 1, 1), (2, 0, 1)]


def test_repeat_length():
    assert S.repeat_length("A" * 34, "A" * 34) == 30
    assert S.repeat_length("N" * 34, "N" * 34) == 0
    a = "ACGTTGCAAGCTTACGGATCCTAGGCTAACGTTA"
    assert S.repeat_length(a, a) == 30
    b = list(a)
    for i in (8, 10, 25, 27):  # the sites are at 17; with two mismatches 11..24 and one side's next stretch agree
        b[i] = "C" if b[i] == "A" else "A"
    assert S.repeat_length(a, "".join(b), wobble=2) >= 24 - 11 + 1 + 2


def test_distributions():
    assert stats.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.gamma_q(2, 3) == pytest.approx(math.exp(-3) * 4)
    assert stats.proportion_test([10, 20], [50, 50]) == pytest.approx(0.0291, abs=2e-4)
    assert stats.proportion_test([0, 0], [5, 5]) == 1.0 and math.isnan(stats.proportion_test([0, 0], [0, 5]))
    s, p = stats.binomial_lr_test([10, 20], [50, 50])
    assert s == pytest.approx(4.83145, abs=1e-4) and 0.02 < p < 0.05
    assert stats.fisher_exact(1, 9, 11, 3)[1] == pytest.approx(0.002759, abs=1e-5)
    stat, p = stats.chi2_table([[10, 20], [30, 40]])
    assert stat == pytest.approx(0.4464, abs=1e-3) and p == pytest.approx(0.504, abs=1e-3)
    assert math.isnan(stats.chi2_table([[1, 2], [0, 0]])[0])
    x = np.array([0.3, 1.0, 7.5])
    assert np.allclose(stats.digamma(x), [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], atol=1e-5)
    assert np.allclose(stats.log_gamma(np.array([1e-6, 0.5, 3.3, 1e6])), [math.lgamma(v) for v in (1e-6, 0.5, 3.3, 1e6)], rtol=1e-10)
    n, q = 20, 0.1
    direct = sum(math.comb(k + 1, 1) * q**2 * (1 - q) ** k for k in range(n + 1))
    assert stats.negative_binomial_cdf(n, 2, q) == pytest.approx(direct)
    t = stats.tpm_threshold(1_000_000)
    assert stats.negative_binomial_cdf(1_000_000 - 2, 2, t * 1e-6) == pytest.approx(0.8, abs=1e-4)


def test_betabinomial_fit_is_a_maximum_and_finds_the_mean():
    r = np.random.default_rng(2)
    n = r.integers(30, 80, 60)
    x = r.binomial(n, r.beta(4, 12, 60))
    a, b, mean, disp, ok = stats.betabinomial_fit(x, n)
    assert ok and mean == pytest.approx(0.25, abs=0.04) and disp == pytest.approx(1 / 17, abs=0.03)
    best = stats.betabinomial_loglik(x[None], n[None], np.array([a]), np.array([b]))[0]
    assert all(stats.betabinomial_loglik(x[None], n[None], np.array([a * f]), np.array([b * g]))[0] <= best + 1e-6 for f in (0.97, 1, 1.03) for g in (0.97, 1, 1.03))
    assert stats.betabinomial_fit([5, 5], [10, 10]) == (0.5, None, 0.5, None, True)
    assert not stats.betabinomial_fit([0], [0])[4]
    same, _ = stats.betabinomial_lr_test([x[:30], x[30:]], [n[:30], n[30:]])
    apart, params = stats.betabinomial_lr_test([x, n - x], [n, n])
    assert same > 0.01 and apart < 1e-6 and len(params) == 6
    assert math.isnan(stats.betabinomial_lr_test([[0], [1]], [[0], [2]])[0])


def test_fits_of_many_events_equal_those_of_one():
    r = np.random.default_rng(5)
    n = r.integers(0, 60, (200, 9)) * (r.random((200, 9)) < 0.8)
    x = r.binomial(n, r.beta(2, 3, (200, 9)))
    x[:5], x[5:9] = 0, n[5:9]
    many = np.stack(stats.betabinomial_fits(x, n), 1)
    for row, a, b in zip(many, x, n):
        keep = b > 0
        one = [math.nan if v is None else v for v in stats.betabinomial_fit(a[keep], b[keep])]
        # far out the likelihood is flat in a and b
        assert row[2:] == pytest.approx(np.array(one[2:], float), abs=1e-4, nan_ok=True)
    p, params = stats.betabinomial_lr_tests([x[:, :4], x[:, 4:]], [n[:, :4], n[:, 4:]])
    assert p.shape == (200,) and params.shape == (200, 6) and ((p >= 0) & (p <= 1) | np.isnan(p)).all()


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, None, 0.5, 0.03, float("nan")]
    got = {r["i"]: r["padj"] for r in stats.adjust_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    m, finite = 5, sorted(v for v in p if v is not None and v == v)
    want = lambda v: min(1, min(q * m / (np.searchsorted(finite, q, "right")) for q in finite if q >= v))
    assert all(got[i] == pytest.approx(want(v)) for i, v in enumerate(p) if v is not None and v == v)
    assert got[3] is None and got[6] is None


def test_filters(spark):
    df = spark.createDataFrame([(1, [1], 0.9, 0, ["FSM"], 5, 100), (2, [1, 2], None, 3, ["novel exon"], 1, 200), (3, None, None, None, None, None, None)], "i int, exons array<int>, a_content double, category int, subs array<string>, coverage int, gene_coverage int")
    f = default_filters()
    pick = lambda q: [r["i"] for r in df.where(f.query(q, "transcript")).orderBy("i").collect()]
    assert pick("FSM or not (INTERNAL_PRIMING or MULTIEXON)") == [1, 3]
    assert pick("NNC and NOVEL_EXON") == [2] and pick("not FSM") == [2, 3] and pick("SUBSTANTIAL") == [1]
    assert tag_name("5' fragment") == "_5_FRAGMENT" and "_5_FRAGMENT" in f.tags["transcript"]
    f.add("DEEP", "coverage >= 5 and category in (0, 1) and coverage is not None")
    assert pick("DEEP") == [1]
    for bad in ("__import__('os')", "exons.x", "lambda: 1", "len(exons, 2)", "a +"):
        with pytest.raises((FilterError, SyntaxError)):
            f.add("BAD", bad) or f.column("BAD")
        f.tags["transcript"].pop("BAD", None)
    with pytest.raises(FilterError):
        f.add("FSM", "category == 1")
    with pytest.raises(FilterError):
        f.query("NO_SUCH")
    f.remove("DEEP")
    with pytest.raises(FilterError):
        Filters().remove("DEEP")


def test_domains(spark):
    b = spark.range(1).select(domain_blocks(F.lit(100), F.array(F.lit(10), F.lit(5), F.lit(7)), F.array(F.lit(0), F.lit(10), F.lit(30))).alias("b"), domain_blocks(F.lit(1), F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("n")).first()
    assert [tuple(x) for x in b["b"]] == [(100, 115), (130, 137)] and b["n"] is None
    tr = spark.createDataFrame([(1, "c", [(90, 115), (130, 150)], (96, 150)), (2, "c", [(90, 115), (120, 125), (130, 150)], (90, 150))], f"transcript_id long, chr string, exons {EXONS}, cds struct<start:long,end:long>")
    dom = spark.createDataFrame([("d", "c", [(102, 115), (130, 137)]), ("d", "c", [(102, 115), (130, 137)]), ("e", "c", [(131, 133)]), ("f", "c", [(149, 151)])], f"domain_id string, chr string, blocks {EXONS}")
    assert sorted(map(tuple, contained(tr, dom).collect())) == [(1, "d", 12, 32), (1, "e", 26, 28), (2, "e", 31, 33)]
    assert {tuple(r)[:2] for r in contained(tr, dom, in_frame=True).collect()} == {(1, "d")}
    hits = spark.createDataFrame([(1, "PF1", 1, 3)], "transcript_id long, accession string, start int, end int")
    t2 = tr.select("transcript_id", F.lit("+").alias("strand"), "exons", F.lit(20).alias("orf_start"))
    assert tuple(hits_on_genome(hits, t2).first())[2:] == (23, 29, 113, 134)
    table = spark.createDataFrame([(1, [1, 2], [3]), (2, [], None)], "k int, a array<int>, b array<int>")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "transcript_id int, label string")
    assert sorted(map(tuple, label_sets(table, "k", "a", "b", labels, ("A-B", "B-A", "A|B", "A&B")).collect())) == [(1, "x", "", "x,y", "y"), (2, "", "", "", "")]


def test_ends(spark):
    y = np.array([0, 1, 0, 5, 5, 0, 2, 1.5, 3, 0])
    assert list(prominent_peaks(y, 1)) == [1, 3, 8] and list(prominent_peaks(y, 2.5)) == [3, 8]
    assert smooth(np.ones(50)).tolist() == pytest.approx([1] * 50)
    data = [("g", "start", 200, p, n) for p, n in ((95, 12), (100, 50), (103, 4), (160, 40), (163, 2))] + [("g", "start", 900, 700, 1)]
    got = {(r["junction"], r["pos"]): r["unified_pos"] for r in unify_ends(spark.createDataFrame(data, "gene_id string, kind string, junction long, pos long, n long")).collect()}
    assert got[200, 95] == got[200, 100] == got[200, 103] and abs(got[200, 100] - 100) <= 2
    assert got[200, 160] == got[200, 163] and abs(got[200, 160] - 160) <= 2
    assert isinstance(pd.DataFrame(data), pd.DataFrame)
