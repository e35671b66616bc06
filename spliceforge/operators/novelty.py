"""Novelty of a transcript against the reference isoforms of its gene."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceforge.session import ship_package

Chain = list[tuple[int, int]]
#: Category that a subcategory raises a transcript to at least.
LEVEL = {
    "5' fragment": 1, "3' fragment": 1, "mono-exon": 1, "novel exonic TSS": 1, "novel exonic PAS": 1, "intron retention": 2, "exon skipping": 2, "novel junction": 2, "novel combination": 2,
    "novel 5' splice site": 3, "novel 3' splice site": 3, "novel exon": 3, "novel intronic TSS": 3, "novel intronic PAS": 3, "readthrough fusion": 4,
}


def chain_of(exons: Chain) -> tuple[tuple[int, int], ...]:
    return tuple((a[1], b[0]) for a, b in zip(exons, exons[1:]))


class Reference:
    """A gene's reference isoforms, prepared for comparisons: exonic union, introns, sites and ends."""

    def __init__(self, chains: list[Chain], strand: str):
        self.chains, self.minus = [sorted(map(tuple, c)) for c in chains], strand == "-"
        self.junctions = {j for c in self.chains for j in chain_of(c)}
        self.patterns = {chain_of(c) for c in self.chains if len(c) > 1}
        self.single = [c[0] for c in self.chains if len(c) == 1]
        bounds = sorted({p for c in self.chains for e in c for p in e})
        exons = [e for c in self.chains for e in c]
        # disjoint pieces, each of which every exon holds wholly or not at all
        self.pieces = [(a, b) for a, b in zip(bounds, bounds[1:]) if any(s <= a and b <= t for s, t in exons)]
        self.lows, self.highs = [p[0] for p in self.pieces], [p[1] for p in self.pieces]
        self.first, self.last = {c[0][0] for c in self.chains}, {c[-1][1] for c in self.chains}

    def within(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pieces that overlap [a, b)."""
        return self.pieces[bisect_right(self.highs, a) : bisect_left(self.lows, b)]

    def gaps(self, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(x[1], y[0]) for x, y in zip(pieces, pieces[1:]) if y[0] > x[1]]

    def classify(self, exons: Chain, fused: frozenset[int] = frozenset()) -> tuple[int, dict[str, list]]:
        """Category and subcategories with their places. ``fused``: exons (from 0) whose junctions belong to another gene."""
        exons = sorted(map(tuple, exons))
        if fused:
            found = {"readthrough fusion": sorted(fused)}
        elif chain_of(exons) in self.patterns if len(exons) > 1 else any(s < exons[0][1] and exons[0][0] < t for s, t in self.single):
            return 0, {"FSM": []}
        else:
            found = {}
        at = [self.within(*e) for e in exons]
        self._truncated(exons, at, found)
        for i, (exon, pieces) in enumerate(zip(exons, at)):
            if i not in fused:
                self._exon(i, exon, pieces, len(exons), found)
        for i in range(len(exons) - 1):
            if i + 1 not in fused:
                self._junction(exons[i], exons[i + 1], found)
        if not found:
            found = {"novel combination": []}
        return max(LEVEL[k] for k in found), found

    def _truncated(self, exons: Chain, at: list, found: dict) -> None:
        """An outer exon that begins or ends inside reference exons, with no reference end in it, but one beyond an intron."""
        if len(exons) < 2:
            return
        head, tail = at[0], at[-1]
        if head and head[0][0] <= exons[0][0] and not any(p[0] in self.first for p in head):
            starts = [c[0][0] for c in self.chains if any(s <= head[0][0] < t for s, t in c)]
            if starts and self.gaps(self.within(max(starts), head[0][1])):
                found.setdefault("3' fragment" if self.minus else "5' fragment", []).append((max(starts), exons[0][0]))
        if tail and tail[-1][1] >= exons[-1][1] and not any(p[1] in self.last for p in tail):
            ends = [c[-1][1] for c in self.chains if any(s <= tail[-1][0] < t for s, t in c)]
            if ends and self.gaps(self.within(tail[-1][0], min(ends))):
                found.setdefault("5' fragment" if self.minus else "3' fragment", []).append((exons[-1][1], min(ends)))

    def _exon(self, i: int, exon: tuple[int, int], pieces: list, n: int, found: dict) -> None:
        head, tail = i == 0, i == n - 1
        add = lambda k, v: found.setdefault(k, []).append(v)
        if not pieces:
            low_end = head
            add(("novel intronic PAS" if low_end == self.minus else "novel intronic TSS") if head or tail else "novel exon", exon)
            return
        if head and tail:
            add("mono-exon", exon)
        else:
            begin, end = pieces[0][0], pieces[-1][1]
            if begin != exon[0]:
                if not head:
                    add(f"novel {'5' if self.minus else '3'}' splice site", (exon[0], min((p[0] - exon[0] for p in pieces), key=abs)))
                elif begin > exon[0] and not any(p[0] in self.first for p in pieces):
                    add(f"novel exonic {'PAS' if self.minus else 'TSS'}", (exon[0], begin))
            if end != exon[1]:
                if not tail:
                    add(f"novel {'3' if self.minus else '5'}' splice site", (exon[1], min((p[1] - exon[1] for p in pieces), key=abs)))
                elif end < exon[1] and not any(p[1] in self.last for p in pieces):
                    add(f"novel exonic {'TSS' if self.minus else 'PAS'}", (end, exon[1]))
        gaps = self.gaps(pieces)
        if not gaps:
            return
        starts_beyond = head and any(p[0] in self.first for p in pieces if p[0] >= gaps[-1][1] and p != pieces[-1])
        ends_before = tail and any(p[1] in self.last for p in pieces if p[1] <= gaps[0][0])
        through = [c for c in self.chains if any(s <= pieces[0][0] < t for s, t in c) and any(s <= pieces[-1][0] < t for s, t in c)]
        if starts_beyond or ends_before or not through:
            return
        held = sorted({j for c in through for j in chain_of(c) if exon[0] <= j[0] and j[1] <= exon[1] and any(j[0] <= g[0] and g[1] <= j[1] for g in gaps)})
        for j in held:
            add("intron retention", j)

    def _junction(self, left: tuple[int, int], right: tuple[int, int], found: dict) -> None:
        """A pair of neighbouring exons that no reference isoform joins, though one goes from one to the other by further exons, or has both sites."""
        j = (left[1], right[0])
        if j in self.junctions:
            return
        skipped = set()
        for c in self.chains:
            out = [k for k, e in enumerate(c[:-1]) if left[0] < e[1] and e[0] < left[1] and e[1] <= left[1]]
            into = [k for k, e in enumerate(c) if right[0] < e[1] and e[0] < right[1]]
            if out and into:
                skipped |= {e for e in c[out[-1] + 1 : into[0]] if left[1] <= e[0] and e[1] <= right[0]}
        if skipped:
            found.setdefault("exon skipping", []).extend(sorted(skipped))
        elif any(p[1] == j[0] for p in self.pieces) and any(p[0] == j[1] for p in self.pieces):
            found.setdefault("novel junction", []).append(j)


def classify_transcripts(transcripts: DataFrame, references: DataFrame, block: int = 5_000) -> DataFrame:
    """transcript_id, novelty (0 to 4), subcategories (sorted text) against the references of the gene.

    ``transcripts``: transcript_id, gene_id, exons; ``references``: gene_id, strand, exons. Distinct chains are compared once. Chains of a gene
    go out in blocks of ``block``, each with the gene's distinct reference chains, so a large gene is spread over tasks. Genes without a
    reference give no row. If both have chr and strand (of one value a gene), exons with a splice site that the gene's references lack and
    another gene's have are taken as read through from there.
    """
    ship_package(transcripts.sparkSession)
    text = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = transcripts.select("transcript_id", "gene_id", text.alias("exons"))
    chains = rows.select("gene_id", "exons").distinct()
    sites = {"chr", "strand"} <= set(transcripts.columns) & set(references.columns)
    through = _read_through(transcripts.withColumn("text", text), references) if sites else chains.select("gene_id", "exons", F.lit("").alias("fused")).limit(0)
    sizes = chains.groupBy("gene_id").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).alias("n_blocks"))
    asked = chains.join(through, ["gene_id", "exons"], "left").join(sizes, "gene_id").select("gene_id", "exons", F.coalesce("fused", F.lit("")).alias("fused"), F.pmod(F.xxhash64("exons"), "n_blocks").alias("block"))
    refs = references.select("gene_id", "strand", text.alias("exons")).distinct().join(sizes, "gene_id")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    refs = refs.select(F.col("gene_id").alias("ref_gene"), blocks.alias("ref_block"), "strand", F.col("exons").alias("ref_exons"))

    def kernel(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(t) and len(r):
            ref = Reference([_pairs(x) for x in r["ref_exons"]], r["strand"].iloc[0])
            for gene, exons, fused in zip(t["gene_id"], t["exons"], t["fused"]):
                novelty, subs = ref.classify(_pairs(exons), frozenset(map(int, filter(None, fused.split(",")))))
                got.append((gene, exons, novelty, ",".join(sorted(subs))))
        return pd.DataFrame(got, columns=["gene_id", "exons", "novelty", "subcategories"])

    out = "gene_id string, exons string, novelty int, subcategories string"
    done = asked.groupBy("gene_id", "block").cogroup(refs.groupBy("ref_gene", "ref_block")).applyInPandas(kernel, out)
    return rows.join(done, ["gene_id", "exons"]).select("transcript_id", "novelty", "subcategories")


def _read_through(transcripts: DataFrame, references: DataFrame) -> DataFrame:
    """gene_id, exons (text), fused (text): numbers of the exons of distinct chains that have a splice site of another gene's references only."""
    each = lambda rows: rows.select("*", F.posexplode("exons").alias("no", "x"), (F.size("exons") - 1).alias("last"))

    def sites(rows: DataFrame, *cols) -> DataFrame:
        side = F.array(F.when(F.col("no") > 0, F.struct(F.lit("start").alias("side"), F.col("x.start").alias("pos"))), F.when(F.col("no") < F.col("last"), F.struct(F.lit("end").alias("side"), F.col("x.end").alias("pos"))))
        return each(rows).select(*cols, "chr", "strand", F.inline(F.array_compact(side))).distinct()

    known = sites(references, "gene_id")
    place = ["chr", "strand", "side", "pos"]
    mine = sites(transcripts.drop("transcript_id").select("gene_id", "chr", "strand", "exons", "text").distinct(), "gene_id", "text", "no")
    foreign = mine.join(known, ["gene_id", *place], "left_anti").join(known.select(*place).distinct(), place, "left_semi")
    return foreign.groupBy("gene_id", F.col("text").alias("exons")).agg(F.array_join(F.sort_array(F.collect_set("no")), ",").alias("fused"))


def _pairs(text: str) -> Chain:
    return [tuple(map(int, e.split("-"))) for e in text.split(",")]
