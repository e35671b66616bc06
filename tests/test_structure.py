"""Graphs and events of the hand-written genes."""

import random

import pytest
from pyspark.sql import functions as F

from spliceforge.functions import stats
from spliceforge.operators import bubbles, collapse, segments
from spliceforge.operators.assign import best_genes, components, loci, novel_genes, novel_types
from spliceforge.operators.novelty import classify_transcripts
from tests.test_novelty import CASES, GENE

EXONS = "array<struct<start:long,end:long>>"
# an intron that is kept or not, and an exon that is skipped or not
T0 = [(5, 15), (31, 42), (57, 75), (90, 104), (150, 160), (190, 200)]
T1 = sorted([*T0, (120, 130)])
T2 = [T0[0], (31, 75), *T0[3:]]
T3 = sorted([*T2, (120, 130)])


def gene(spark, chains, strand="+", reads=None, name="g"):
    data = [(name, "chr1", strand, i, [*map(tuple, c)], (reads or [1] * len(chains))[i]) for i, c in enumerate(chains)]
    return spark.createDataFrame(data, f"gene_id string, chr string, strand string, isoform long, exons {EXONS}, reads long")


def graph(iso):
    rows = segments.exon_rows(iso)
    segs = segments.segments(rows)
    return segs, segments.paths(segments.spans(rows, segs)), iso.select("gene_id", "strand").distinct()


def sets(events, *extra):
    out = {}
    for r in events.collect():
        out.setdefault((r["event_type"], r["node_a"], r["node_b"], *[r[e] for e in extra]), {"primary": set(), "alternative": set()})[r["side"]].add(r["isoform"])
    return out


def test_coordinated_gene(spark):
    iso = gene(spark, [T0, T1, T2, T3], reads=[240, 40, 70, 290])
    segs, path, strand = graph(iso)
    assert [(r["start"], r["end"]) for r in segs.orderBy("node").collect()] == [(5, 15), (31, 42), (42, 57), (57, 75), (90, 104), (120, 130), (150, 160), (190, 200)]
    got = sets(bubbles.simple_events(path, strand))
    assert got == {("IR", 1, 3): {"primary": {0, 1}, "alternative": {2, 3}}, ("ES", 4, 6): {"primary": {0, 2}, "alternative": {1, 3}}}
    totals = {r["event_type"]: r for r in bubbles.with_coordinates(bubbles.event_totals(bubbles.simple_events(path, strand), iso.select("gene_id", "isoform", "reads")), segs).collect()}
    assert (totals["IR"]["start"], totals["IR"]["end"], totals["ES"]["start"], totals["ES"]["end"]) == (42, 57, 104, 150)
    assert (totals["IR"]["primary_reads"], totals["IR"]["alternative_reads"]) == (280, 360)
    restored = {r["isoform"]: [tuple(x) for x in r["exons"]] for r in segments.restore(path, segs).collect()}
    assert restored == {0: T0, 1: T1, 2: T2, 3: T3}
    edge = {(r["node_a"], r["node_b"]): (r["spliced"], r["n_isoforms"]) for r in segments.edges(path).collect()}
    assert edge[1, 2] == (False, 2) and edge[1, 3] == (True, 2)


def test_splice_site_types_swap_on_the_other_strand(spark):
    chains = [[(0, 10), (40, 50), (90, 99)], [(0, 20), (40, 50), (90, 99)], [(0, 10), (30, 50), (90, 99)]]
    plus = {k[0] for k in sets(bubbles.simple_events(*(lambda g: (g[1], g[2]))(graph(gene(spark, chains)))))}
    minus = {k[0] for k in sets(bubbles.simple_events(*(lambda g: (g[1], g[2]))(graph(gene(spark, chains, "-")))))}
    assert plus == {"5AS", "3AS"} == minus
    only = [chains[0], chains[1]]
    assert {k[0] for k in sets(bubbles.simple_events(*(lambda g: (g[1], g[2]))(graph(gene(spark, only)))))} == {"5AS"}
    assert {k[0] for k in sets(bubbles.simple_events(*(lambda g: (g[1], g[2]))(graph(gene(spark, only, "-")))))} == {"3AS"}


def test_mutually_exclusive_exons(spark):
    chains = [[(0, 10), (20, 30), (60, 70)], [(0, 10), (40, 50), (60, 70)], [(0, 10), (60, 70)]]
    segs, path, _ = graph(gene(spark, chains))
    assert sets(bubbles.exclusive_events(path)) == {("ME", 0, 3): {"primary": {1}, "alternative": {0}}}


def test_start_and_end_events(spark):
    chains = [[(0, 10), (40, 50), (60, 70)], [(20, 30), (40, 50), (60, 70)], [(40, 55)]]
    iso = gene(spark, chains, reads=[5, 7, 11])
    segs, path, strand = graph(iso)
    rows = {(r["event_type"], r["start"], r["end"]): (r["primary_reads"], r["alternative_reads"]) for r in bubbles.with_coordinates(bubbles.end_event_totals(path, strand, iso.select("gene_id", "isoform", "reads")), segs).collect()}
    assert rows[("TSS", 0, 10)] == (18, 5) and rows[("TSS", 20, 30)] == (16, 7)
    assert rows[("PAS", 60, 70)] == (11, 12)
    listed = sets(bubbles.end_events(path, strand))
    assert {v["alternative"].pop() for k, v in listed.items() if k[0] == "TSS"} == {0, 1}


def test_fragments(spark):
    chains = [T0, T0[1:4], T0[1:], T0[2:4], [(500, 510)]]
    _, path, strand = graph(gene(spark, chains))
    got = {(r["isoform"], r["container"]): (r["missing_5"], r["missing_3"]) for r in segments.fragments(path, strand).collect()}
    assert got == {(1, 0): (1, 2), (2, 0): (1, 0), (3, 0): (2, 2)}
    _, path, strand = graph(gene(spark, [T0, T0[1:4]], "-"))
    assert [(r["missing_5"], r["missing_3"]) for r in segments.fragments(path, strand).collect()] == [(2, 1)]


def test_fragments_meet_only_where_they_fit(spark):
    """Against all pairs, with starts, ends and single exons that reach farther, equal chains, and introns that many share."""
    rng = random.Random(3)
    chains = [[(rng.choice([0, 3, 6]), 10), (20, 30), (40, 50), (60, rng.choice([65, 70]))][a:b] for a in range(4) for b in range(a + 1, 5) for _ in range(3)] + [[(22, 28)], [(19, 30)], [(20, 30), (41, 50)]]
    rows = [(g, i + 100 * n, s, x) for n, (g, s) in enumerate((("g", "+"), ("h", "-"))) for i, x in enumerate(chains)]
    within = lambda x, y: any(len(y) - i >= len(x) and y[i][0] <= x[0][0] and x[-1][1] <= y[i + len(x) - 1][1] and [p for e in x for p in e][1:-1] == [p for e in y[i : i + len(x)] for p in e][1:-1] for i in range(len(y)))
    pairs = {(i, j) for g, i, _, x in rows for h, j, _, y in rows if g == h and i != j and within(x, y) and (x != y or j < i)}
    df = spark.createDataFrame(rows, f"gene_id string, isoform long, strand string, exons {EXONS}")
    assert {(r["small"], r["container"]) for r in segments.containments(df, df).collect()} == pairs
    assert {r["isoform"] for r in segments.contained(df).collect()} == {i for i, _ in pairs}
    got = segments.chain_fragments(df)
    assert {(r["isoform"], r["container"]) for r in got.collect()} == {(i, j) for i, j in pairs if j not in {k for k, _ in pairs}}


def test_isoforms_and_weighted_medians(spark):
    data = [
        ("g", "c", "+", 1, "s", [(0, 10), (20, 30)], 1), ("g", "c", "+", 2, "s", [(4, 10), (20, 40)], 5), ("g", "c", "+", 3, "s", [(2, 10), (20, 35)], 1), ("g", "c", "+", 4, "s", [(0, 10), (21, 30)], None),
        ("g", "c", "+", 5, "s", [(100, 110)], 1), ("g", "c", "+", 6, "s", [(109, 120)], 2), ("g", "c", "+", 7, "s", [(120, 130)], 1), ("g", "c", "-", 8, "s", [(100, 110)], 1),
    ]
    df = spark.createDataFrame(data, f"gene_id string, chr string, strand string, transcript_id long, sample_name string, exons {EXONS}, coverage long")
    iso = {r["isoform"]: ([tuple(x) for x in r["exons"]], r["n_transcripts"], r["reads"]) for r in collapse.isoforms(collapse.with_chain(df)).collect()}
    assert iso[1] == ([(4, 10), (20, 40)], 3, 7)
    assert iso[4] == ([(0, 10), (21, 30)], 1, 0)
    assert iso[5] == ([(109, 120)], 2, 3)  # the overlap of both; 7 only touches
    assert set(iso) == {1, 4, 5, 7, 8}


def test_best_gene_prefers_shared_sites(spark):
    t = spark.createDataFrame([(1, "c", "+", [(0, 10), (20, 30)]), (2, "c", "+", [(100, 120)]), (3, "c", "+", [(119, 140)]), (4, "c", "-", [(0, 10)])], f"transcript_id long, chr string, strand string, exons {EXONS}")
    g = spark.createDataFrame([("a", "c", "+", [(5, 10), (20, 25)]), ("b", "c", "+", [(0, 40)]), ("d", "c", "+", [(100, 120)])], f"gene_id string, chr string, strand string, exons {EXONS}")
    got = {r["transcript_id"]: (r["gene_id"], r["step"], r["n_sites"], r["n_bases"]) for r in best_genes(t, g).collect()}
    assert got == {1: ("a", 1, 2, 10), 2: ("d", 3, 0, 20)}
    kinds = {r["transcript_id"]: r["novel_type"] for r in novel_types(t, g).collect()}
    assert kinds == {1: "genic genomic", 2: "genic genomic", 3: "genic genomic", 4: "antisense"}


def test_steps_of_placement(spark):
    g = [("a", [(0, 100), (200, 300), (400, 500)], True), ("b", [(0, 100), (250, 300)], True), ("n", [(600, 700), (800, 900)], False), ("m", [(1000, 1050)], True), ("l", [(990, 3000), (3100, 3200)], True), ("o", [(5000, 5100)], False)]
    genes = spark.createDataFrame([(i, "c", "+", x, k) for i, x, k in g], f"gene_id string, chr string, strand string, exons {EXONS}, is_annotated boolean")
    cases = {
        1: ([(50, 100), (200, 300)], "a", 1), 2: ([(90, 100), (250, 300)], "b", 1), 3: ([(650, 700), (800, 850)], "n", 2), 4: ([(1000, 1010), (1030, 1050)], "l", 3),
        5: ([(1010, 1045)], "m", 3), 6: ([(2900, 3050)], "l", 4), 7: ([(5050, 5120)], "o", 5), 8: ([(5090, 5400)], None, None), 9: ([(5000, 5040), (5060, 5090)], "o", 5),
    }
    t = spark.createDataFrame([(i, "c", "+", x) for i, (x, *_) in cases.items()], f"transcript_id long, chr string, strand string, exons {EXONS}")
    got = {r["transcript_id"]: (r["gene_id"], r["step"]) for r in best_genes(t, genes).collect()}
    assert got == {i: (gene, step) for i, (_, gene, step) in cases.items() if gene}
    assert best_genes(t.limit(0), genes).count() == 0


def test_part_of_a_chain_that_a_gene_has_on_two_chromosomes(spark):
    g = spark.createDataFrame([("a", c, "+", [(0, 50), (1000, 1050)]) for c in ("c", "d")] + [("b", "c", "+", [(5000, 5400)])], f"gene_id string, chr string, strand string, exons {EXONS}")
    t = spark.createDataFrame([(1, "c", "+", [(10, 45), (2000, 2900)]), (2, "c", "+", [(5380, 6000)]), (3, "c", "+", [(4990, 6990)])], f"transcript_id long, chr string, strand string, exons {EXONS}")
    got = {tuple(r) for r in best_genes(t, g).collect()}
    assert got == {(1, "a", 4, 0, 35), (3, "b", 4, 0, 400)}


def test_best_genes_equal_all_pairs(spark):
    """Genes that overlap on few sites, so that all ties and all ways to settle a part occur, against transcripts compared with each chain."""
    rng = random.Random(7)
    sites = rng.sample(range(100, 30_000), 30)

    def chain(least=1):
        k = max(least, rng.choice([1, 1, 1, 2, 3, 4]))
        at = sorted(rng.sample(sites if rng.random() < 0.6 else range(50, 45_000), 2 * k))
        return [(at[2 * i], at[2 * i + 1]) for i in range(k)]

    genes = [(g, rng.choice("cd"), "+", chain(2 if g in "abcd" else 1), g in "abcde") for g in rng.choices("abcdefgh", k=40)]
    reads = [(i, rng.choice("cd"), "+", chain()) for i in range(250)]
    length = lambda x: sum(b - a for a, b in x)
    both = lambda x, y: sum(max(0, min(b, d) - max(a, c)) for a, b in x for c, d in y)
    marks = lambda x: {("d", x[i][1]) for i in range(len(x) - 1)} | {("a", x[i + 1][0]) for i in range(len(x) - 1)}
    want = {}
    for t, c, _, x in reads:
        ranks = []
        for name in "abcdefgh":
            chains = [g[3] for g in genes if g[:2] == (name, c)]
            bases = len({p for a, b in x for y in chains for e, f in y for p in range(max(a, e), min(b, f))})
            if not bases:
                continue
            n, known, least = len(marks(x) & set().union(*map(marks, chains))), name in "abcde", length(x) * 0.25
            whole = bases if len(x) > 1 else max([both(x, y) for y in chains if len(y) == 1], default=0)
            part = max(both(x, y) / min(length(x), length(y)) for y in chains)
            step = 1 if known and n else 2 if n else 3 if known and whole >= least else 4 if known and part >= 0.25 else 5 if not known and bases >= least else None
            if step:
                first = n if step < 3 else whole if step == 3 else part if step == 4 else bases
                ranks.append((step, -first, -max(len(marks(x) & marks(y)) / len(y) for y in chains) if step < 3 else 0, -bases, name, n))
        if ranks:
            step, _, _, bases, name, n = min(ranks)
            want[t] = (name, step, n, -bases)
    t = spark.createDataFrame(reads, f"transcript_id long, chr string, strand string, exons {EXONS}")
    g = spark.createDataFrame(genes, f"gene_id string, chr string, strand string, exons {EXONS}, is_annotated boolean")
    assert {r[0]: tuple(r)[1:] for r in best_genes(t, g).collect()} == want
    assert {v[1] for v in want.values()} >= {1, 2, 3, 4}


def test_novel_genes_share_sites_or_most_bases(spark):
    chains = {
        1: [(0, 10), (20, 30)], 2: [(5, 10), (40, 60)], 3: [(5, 8), (40, 55)], 4: [(100, 200)], 5: [(130, 220)], 6: [(145, 245)], 7: [(190, 400)], 8: [(100, 200)], 9: [(0, 10), (20, 30)],
    }
    strand = {9: "-"}
    t = spark.createDataFrame([(i, "c", strand.get(i, "+"), x) for i, x in chains.items()], f"transcript_id long, chr string, strand string, exons {EXONS}")
    by = {}
    for r in novel_genes(t).collect():
        by.setdefault(r["novel_gene"], set()).add(r["transcript_id"])
    # 2 has the site 10 with 1 and most bases with 3; 4, 5 and 6 form a chain of overlaps; 8 is 4 again
    assert sorted(map(sorted, by.values())) == [[1, 2, 3], [4, 5, 6, 8], [7], [9]]
    assert sorted(by) == [f"PB_novel_{k:05d}" for k in range(1, 5)] and by["PB_novel_00001"] == {1, 2, 3}


def test_components(spark):
    import random

    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(90), r.randrange(90)) for _ in range(50)] + [(7, 7), (5, 6), (6, 5)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in list(up)}


def test_loci_by_gap(spark):
    g = spark.createDataFrame([("c", 0, 10), ("c", 15, 20), ("c", 31, 40), ("d", 0, 1)], "chr string, s int, e int")
    assert sorted((r["chr"], r["s"], r["locus_no"]) for r in loci(g, ["chr"], "s", "e", 10).collect()) == [("c", 0, 1), ("c", 15, 1), ("c", 31, 2), ("d", 0, 1)]


def test_classifier_over_frames(spark):
    ref = spark.createDataFrame([("g", "+", c) for c in GENE], f"gene_id string, strand string, exons {EXONS}")
    tr = spark.createDataFrame([(i, "g" if i else "other", c) for i, (*_, c) in enumerate(CASES)], f"transcript_id long, gene_id string, exons {EXONS}")
    got = {r["transcript_id"]: r["subcategories"] for r in classify_transcripts(tr, ref, block=4).collect()}
    assert 0 not in got and all(name in got[i].split(",") for i, (_, name, _) in enumerate(CASES) if i)


def test_coordination_numbers(spark):
    row = spark.range(1).select(stats.log2_odds_ratio(F.lit(240), F.lit(40), F.lit(70), F.lit(290)).alias("l")).first()
    assert row["l"] == pytest.approx(4.6356, abs=1e-4)
    assert stats.fisher_exact(240, 40, 70, 290)[1] < 0.05
