"""Sequence expressions and kernels. Sequences are upper-case text; positions are 0-based."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: The standard genetic code, codons in the order TCAG, TCAG, TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
STARTS, STOPS = ("ATG",), ("TAA", "TAG", "TGA")
CANONICAL = "GTAG"
#: Bases upstream of the last junction beyond which a stop leads to decay.
NMD_DISTANCE = 55


def reverse_complement(seq: Column) -> Column:
    """Other letters than A, C, G, T become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def base_share(seq: Column, base: str, length: int) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), f"[^{base}]", "")) / F.lit(length)


def downstream(seq: Column, start: Column, end: Column, strand: Column, length: int = 30) -> Column:
    """Share of A behind the end of a transcript on its strand; ``seq`` is the contig's sequence."""
    plus = base_share(F.substring(seq, end + 1, F.lit(length)), "A", length)
    lo = F.greatest(start - length, F.lit(0))
    minus = base_share(F.substring(seq, lo + 1, start - lo), "T", length)
    return F.when(strand == "-", minus).otherwise(plus)


def splice_motif(seq: Column, donor: Column, acceptor: Column, strand: Column) -> Column:
    """The two bases at either end of an intron, as read on the strand (GTAG is canonical)."""
    four = F.concat(F.substring(seq, donor + 1, F.lit(2)), F.substring(seq, acceptor - 1, F.lit(2)))
    return F.when(strand == "-", reverse_complement(four)).otherwise(four)


def spliced(seq: Column, exons: Column, strand: Column) -> Column:
    whole = F.array_join(F.transform(exons, lambda x: F.substring(seq, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))), "")
    return F.when(strand == "-", reverse_complement(whole)).otherwise(whole)


def window_content(df, seq: str, keys: list[str], width: int, bases: str = "AT"):
    """Per position of a sequence, the greater of its counts of two bases in the ``width`` bases from there."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - width, F.lit(0)))
    rows = df.where(F.length(seq) >= width).select(*keys, seq, F.explode(starts).alias("pos"))
    part = F.substring(F.col(seq), F.col("pos") + 1, F.lit(width))
    count = lambda b: F.length(F.regexp_replace(part, f"[^{b}]", ""))
    return rows.select(*keys, "pos", F.greatest(count(bases[0]), count(bases[1])).alias("most"))


def translate(seq: str) -> str:
    """Protein of a sequence, X for codons with other letters."""
    return "".join(CODONS.get(seq[i : i + 3], "X") for i in range(0, len(seq) - 2, 3))


@F.pandas_udf(T.StringType())
def translate_udf(seq: pd.Series) -> pd.Series:
    return seq.map(translate, na_action="ignore")


def open_frames(seq: str, starts: tuple[str, ...] = STARTS, stops: tuple[str, ...] = STOPS, annotated: frozenset[int] = frozenset()) -> list[tuple[int, int, int, int]]:
    """(start, end, frame, number of start codons before it) of the open reading frames, in the order of their starts.

    A frame ends behind the first stop codon that follows in it. Starts within an open frame are skipped unless ``annotated``;
    a start without a stop gives a frame of no length.
    """
    found_starts = sorted({m.start() for s in starts for m in re.finditer(f"(?={s})", seq)} | set(annotated))
    found_stops = [sorted(m.start() for s in stops for m in re.finditer(f"(?={s})", seq) if m.start() % 3 == f) for f in range(3)]
    open_until, out = [-1, -1, -1], []
    for n, a in enumerate(found_starts):
        f = a % 3
        if a < open_until[f] and a not in annotated:
            continue
        k = int(np.searchsorted(found_stops[f], a))
        end = found_stops[f][k] + 3 if k < len(found_stops[f]) else a
        open_until[f] = max(open_until[f], end)
        out.append((a, end, f, n))
    return out


#: Per cent of A, C, G and T at the places -12 to -1 and 4 (behind the start codon) of vertebrate messengers (Kozak 1987).
KOZAK_COUNTS = (
    (23, 35, 23, 19), (26, 35, 21, 18), (25, 35, 22, 18), (23, 26, 33, 18), (19, 39, 23, 19), (23, 37, 20, 20), (17, 19, 44, 20),
    (18, 39, 23, 20), (25, 53, 15, 7), (61, 2, 36, 1), (27, 49, 13, 11), (15, 55, 21, 9), (23, 16, 46, 15),
)
KOZAK_PLACES = (*range(-12, 0), 3)


def _kozak_weights() -> dict[int, dict[str, float]]:
    """Log ratio of each base's share at a place to its share over all places."""
    counts = np.array(KOZAK_COUNTS, float)
    weights = np.log2(counts / 100 / (counts.sum(0) / counts.sum()))
    return {p: dict(zip(BASES, map(float, w))) for p, w in zip(KOZAK_PLACES, weights)}


KOZAK = _kozak_weights()


def kozak_score(seq: str, start: int, weights: dict[int, dict[str, float]] = KOZAK) -> float:
    """Summed weights of the bases around a start codon, by offset from it; other letters and places outside count 0."""
    return float(sum(w.get(seq[start + o], 0.0) for o, w in weights.items() if 0 <= start + o < len(seq)))


def best_frame(seq: str, min_len: int = 300, max_5utr: int = 500, annotated: frozenset[int] = frozenset(), min_kozak: float | None = None, weights: dict | None = None) -> tuple[int, int, int] | None:
    """(start, end, number of upstream starts): the longest frame with an annotated start, else the first that is long enough, whose
    start lies early enough and whose surroundings score enough."""
    frames = open_frames(seq, annotated=annotated)
    known = [f for f in frames if f[0] in annotated and f[1] > f[0]]
    if known:
        a, b, _, n = max(known, key=lambda f: f[1] - f[0])
        return a, b, n
    for a, b, _, n in frames:
        if b - a > min_len and a <= max_5utr and (min_kozak is None or kozak_score(seq, a, weights or {}) >= min_kozak):
            return a, b, n
    return None


def hexamer_score(seq: str, table: dict[str, tuple[float, float]]) -> float | None:
    """Mean log ratio of the coding to the noncoding frequency of the in-frame hexamers; None without a hexamer of the table.

    Of a hexamer with only one frequency above 0 the ratio counts as 1 or -1 (in logs).
    """
    logs = []
    for i in range(0, len(seq) - 5, 3):
        coding, other = table.get(seq[i : i + 6], (0.0, 0.0))
        if coding > 0 and other > 0:
            logs.append(float(np.log(coding / other)))
        elif coding > 0 or other > 0:
            logs.append(1.0 if coding > 0 else -1.0)
    return sum(logs) / len(logs) if logs else None


# The published TESTCODE statistic (Fickett 1982). Each base has a probability for its position score and for its share, by the first limit that
# the value reaches, and a weight for each.
POSITION_LIMITS = (1.9, 1.8, 1.7, 1.6, 1.5, 1.4, 1.3, 1.2, 1.1, 0.0)
POSITION_PROBABILITY = {
    "A": (0.94, 0.68, 0.84, 0.93, 0.58, 0.68, 0.45, 0.34, 0.20, 0.22),
    "C": (0.80, 0.70, 0.70, 0.81, 0.66, 0.48, 0.51, 0.33, 0.30, 0.23),
    "G": (0.90, 0.88, 0.74, 0.64, 0.53, 0.48, 0.27, 0.16, 0.08, 0.08),
    "T": (0.97, 0.97, 0.91, 0.68, 0.69, 0.44, 0.54, 0.20, 0.09, 0.09),
}
POSITION_WEIGHT = {"A": 0.26, "C": 0.18, "G": 0.31, "T": 0.33}
CONTENT_LIMITS = (0.33, 0.31, 0.29, 0.27, 0.25, 0.23, 0.21, 0.19, 0.17, 0.0)
CONTENT_PROBABILITY = {
    "A": (0.28, 0.49, 0.44, 0.55, 0.62, 0.49, 0.67, 0.65, 0.81, 0.21),
    "C": (0.82, 0.64, 0.51, 0.64, 0.59, 0.59, 0.43, 0.44, 0.39, 0.31),
    "G": (0.40, 0.54, 0.47, 0.64, 0.64, 0.73, 0.41, 0.41, 0.33, 0.29),
    "T": (0.28, 0.24, 0.39, 0.40, 0.55, 0.75, 0.56, 0.69, 0.51, 0.58),
}
CONTENT_WEIGHT = {"A": 0.11, "C": 0.12, "G": 0.15, "T": 0.14}


def testcode(seq: str) -> float | None:
    """Coding potential of a sequence by the uneven use of bases over the three codon places; None without a base."""
    if not seq:
        return None
    total = 0.0
    for base in BASES:
        by_place = [seq[k::3].count(base) for k in range(3)]
        place, share = max(by_place) / (min(by_place) + 1), sum(by_place) / len(seq)
        total += POSITION_WEIGHT[base] * POSITION_PROBABILITY[base][next(i for i, x in enumerate(POSITION_LIMITS) if place >= x)]
        total += CONTENT_WEIGHT[base] * CONTENT_PROBABILITY[base][next(i for i, x in enumerate(CONTENT_LIMITS) if share >= x)]
    return total


def decays(stop: int, exon_lengths: list[int]) -> bool:
    """Whether a stop codon lies more than NMD_DISTANCE bases upstream of the last junction."""
    return len(exon_lengths) > 1 and sum(exon_lengths[:-1]) - stop > NMD_DISTANCE


@F.pandas_udf(T.DoubleType())
def testcode_udf(seq: pd.Series) -> pd.Series:
    return seq.map(testcode, na_action="ignore").astype(float)


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "upstream")]))
def frame_udf(seq: pd.Series) -> pd.DataFrame:
    found = [best_frame(s, 30, 500) if isinstance(s, str) else None for s in seq]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "end", "upstream"]).astype("Int32")


def repeat_length(a: str, b: str, delta: int = 15, max_mm: int = 2, wobble: int = 2) -> int:
    """Most bases that agree around two sites with up to ``max_mm`` mismatches between them, over all shifts up to ``wobble``.

    ``a`` and ``b`` hold delta + wobble bases on either side of the sites, padded with N (which agrees with nothing); ``b`` stays and
    ``a`` is shifted. The stretch has no other mismatch from its left to its right end, and the sites lie in it or at its ends.
    """
    fixed = np.frombuffer(b[wobble : wobble + 2 * delta].encode(), np.uint8)
    best = 0
    for shift in range(2 * wobble + 1):
        moved = np.frombuffer(a[shift : shift + 2 * delta].encode(), np.uint8)
        wrong = (moved != fixed) | (moved == ord("N"))
        sides = [np.append(np.flatnonzero(side), [delta] * (max_mm + 1)) for side in (wrong[:delta][::-1], wrong[delta:])]
        # agreeing bases before the (k+1)-th mismatch: its distance less the k before it, or all of them if there are fewer
        reach = [[int(d[k] - min(k, np.count_nonzero(d[:k] < delta))) for k in range(max_mm + 1)] for d in sides]
        best = max(best, max(reach[0][k] + reach[1][max_mm - k] for k in range(max_mm + 1)))
    return best
