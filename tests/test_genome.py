"""Genome operators against plain slices of a small genome, over tiles much shorter than its introns."""

import random

import pytest

from spliceforge.functions import sequence as S
from spliceforge.operators import genome as G
from spliceforge.sources.files import tiles

SIZE = 50
EXONS = "array<struct<start:long,end:long>>"
RC = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(8)
    contigs = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("c1", 1500), ("c2", 700))}
    rows = []
    for i in range(40):
        c = r.choice(list(contigs))
        cuts = sorted(r.sample(range(20, len(contigs[c]) - 40), 2 * r.randrange(1, 5)))
        rows.append((i, "g", c, r.choice("+-"), list(zip(cuts[::2], cuts[1::2]))))
    rows.append((99, "g", "nowhere", "+", [(5, 10), (20, 30)]))
    df = spark.createDataFrame([(*t, t[4][0][0], t[4][-1][1], "x") for t in rows], f"transcript_id long, gene_id string, chr string, strand string, exons {EXONS}, tr_start long, tr_end long, seq string")
    genome = tiles(spark.createDataFrame(list(contigs.items()), "name string, seq string"), SIZE, 64)
    return contigs, rows, df.repartition(3), genome


def on_strand(seq, strand):
    return seq if strand == "+" else seq.translate(RC)[::-1]


def test_motifs_and_a_content(world):
    contigs, rows, df, genome = world
    got = {r["transcript_id"]: (r["a_content"], r["noncanonical"]) for r in G.qc_metrics(df, genome, SIZE).collect()}
    for i, _, c, strand, exons in rows:
        if c not in contigs:
            assert got[i] == (None, [])
            continue
        g = contigs[c]
        odd = [k for k, (a, b) in enumerate(zip(exons, exons[1:])) if on_strand(g[a[1] : a[1] + 2] + g[b[0] - 2 : b[0]], strand) != "GTAG"]
        lo, hi = exons[0][0], exons[-1][1]
        share = g[hi : hi + 30].count("A") / 30 if strand == "+" else g[max(lo - 30, 0) : lo].count("T") / 30
        assert got[i][1] == odd and got[i][0] == pytest.approx(share)


def test_sequences(world):
    contigs, rows, df, genome = world
    got = {r["transcript_id"]: r["seq"] for r in G.spliced_sequences(df, genome, SIZE).collect()}
    assert got == {i: on_strand("".join(contigs[c][a:b] for a, b in x), s) for i, _, c, s, x in rows if c in contigs}
    assert G.spliced_sequences(df.limit(0), genome, SIZE).count() == 0


def test_repeats(world):
    contigs, rows, df, genome = world
    got = {(r["chr"], r["donor"], r["acceptor"]): r["repeat_length"] for r in G.intron_repeats(df, genome, SIZE).collect()}
    for (c, d, a), n in got.items():
        if c in contigs:
            pad = lambda p: contigs[c][p - 17 : p + 17].ljust(34, "N")
            assert n == S.repeat_length(pad(d), pad(a))
    assert sum(n is not None for n in got.values()) > 10


def test_frames_on_the_genome(spark, world):
    contigs, rows, df, genome = world
    seqs = G.spliced_sequences(df, genome, SIZE)
    known = {i: [7] for i, *_ in rows[:10]}
    starts = spark.createDataFrame(list(known.items()), "transcript_id long, starts array<long>")
    got = {r["transcript_id"]: r for r in G.predict_orfs(df, seqs, starts, min_len=15).collect()}
    for i, _, c, strand, exons in rows:
        if c not in contigs:
            assert i not in got
            continue
        seq = on_strand("".join(contigs[c][a:b] for a, b in exons), strand)
        want = S.best_frame(seq, 15, 500, frozenset(known.get(i, [])))
        assert (want is None) == (i not in got)
        if want is None:
            continue
        r, places = got[i], [p for a, b in exons for p in range(a, b)]
        assert (r["start"], r["end"], r["upstream"]) == want and r["utr5"] + r["cds"] + r["utr3"] == len(seq)
        assert r["start_codon"] == seq[want[0] : want[0] + 3] and r["annotated"] == (want[0] in known.get(i, []))
        coded = set(places[want[0] : want[1]] if strand == "+" else places[len(seq) - want[1] : len(seq) - want[0]])
        assert coded == {p for p in places if r["cds_start"] <= p < r["cds_end"]}
        ends = [b - a for a, b in (exons if strand == "+" else reversed(exons))]
        assert r["nmd"] == S.decays(want[1], ends) and r["kozak"] == pytest.approx(S.kozak_score(seq, want[0]))


def test_annotated_starts(spark):
    ref = [("g", "+", [(0, 10), (20, 40), (60, 90)], (25, 80)), ("g", "-", [(0, 10), (20, 40), (60, 90)], (5, 30)), ("h", "+", [(0, 10)], None)]
    tr = [
        (1, "g", "+", [(5, 10), (20, 70)]), (2, "g", "+", [(0, 12), (20, 40)]), (3, "g", "+", [(0, 10), (30, 40)]), (4, "h", "+", [(0, 10)]),
        (5, "g", "-", [(0, 10), (20, 40), (60, 70)]), (6, "g", "-", [(25, 40), (61, 70)]),
    ]
    references = spark.createDataFrame(ref, f"gene_id string, strand string, exons {EXONS}, cds struct<start:long,end:long>")
    plus, minus = references.where("strand = '+'"), references.where("strand = '-'")
    df = spark.createDataFrame(tr, f"transcript_id long, gene_id string, strand string, exons {EXONS}")
    got = {r["transcript_id"]: r["starts"] for r in G.annotated_starts(df.where("strand = '+'"), plus).union(G.annotated_starts(df.where("strand = '-'"), minus)).collect()}
    assert got == {1: [10], 5: [20]}


def test_kozak_weights_favour_the_consensus():
    assert S.kozak_score("GCCGCCACCATGG", 9) > S.kozak_score("TTTTTTTTTATGT", 9)
    assert all(abs(sum(c) - 100) <= 1 for c in S.KOZAK_COUNTS)


def test_motifs_of_given_places(spark, world):
    contigs, _, df, t = world
    places = G.distinct_introns(df)
    got = {tuple(r) for r in G.motifs_of(places, t, SIZE).collect()}
    want = lambda c, strand, d, a: on_strand(contigs[c][d : d + 2] + contigs[c][a - 2 : a], strand) if c in contigs else None
    assert got == {(*r, want(*r)) for r in map(tuple, places.collect())}


def test_filter_stats_reads_transcripts_once(spark, monkeypatch):
    from spliceforge.plans import model, summary

    calls, real = [], model.transcripts
    monkeypatch.setattr(model, "transcripts", lambda *a: calls.append(a) or real(*a))
    assert summary.filter_stats(spark, "/root/testdata/sf0.001").count() and len(calls) == 1
