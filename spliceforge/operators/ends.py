"""Unification of transcript ends: read ends of a gene are moved to the peaks of their smoothed histogram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spliceforge.session import ship_package


def smooth(x: np.ndarray, window: int = 31) -> np.ndarray:
    """Weighted mean with a Hann window, of the same length."""
    w = np.hanning(window)
    return np.convolve(np.pad(x, window // 2, mode="edge"), w / w.sum(), mode="valid")[: len(x)]


def prominent_peaks(y: np.ndarray, least: float) -> np.ndarray:
    """Local maxima (the middle of a plateau) that stand out by ``least`` from the higher of the lowest points towards higher ground."""
    padded = np.concatenate([[-np.inf], y, [-np.inf]])
    keep, i = [], 1
    while i <= len(y):
        j = i
        while padded[j + 1] == padded[i]:
            j += 1
        if padded[i - 1] < padded[i] > padded[j + 1]:
            top = (i + j) // 2 - 1
            higher = np.flatnonzero(y > y[top])
            left, right = higher[higher < top], higher[higher > top]
            bases = [y[(left[-1] if len(left) else 0) : top + 1].min(), y[top : (right[0] if len(right) else len(y) - 1) + 1].min()]
            if y[top] - max(bases) >= least:
                keep.append(top)
        i = j + 1
    return np.array(keep, int)


def weighted_median(pos: np.ndarray, n: np.ndarray, share: float = 0.5) -> int:
    order = np.argsort(pos, kind="stable")
    run = np.cumsum(n[order])
    return int(pos[order][np.searchsorted(run, share * run[-1])])


def unified(pos: np.ndarray, n: np.ndarray, peaks: np.ndarray, junction: float, is_start: bool, search: tuple[float, float] = (0.1, 0.9), margin: int = 3) -> np.ndarray:
    """Each position's nearest peak among those within the given quantiles (the median where there is none) that lie at least ``margin``
    from the junction on the transcript's outer side; a position without such a peak stays."""
    low, high = weighted_median(pos, n, search[0]), weighted_median(pos, n, search[1])
    own = peaks[(peaks > low) & (peaks <= high)]
    if not len(own):
        own = np.array([weighted_median(pos, n)])
    if junction == junction:
        own = own[(junction - own if is_start else own - junction) >= margin]
    return own[np.abs(pos[:, None] - own[None, :]).argmin(1)] if len(own) else pos


def unify_ends(ends: DataFrame, window: int = 31, prominence: float = 1.0) -> DataFrame:
    """gene_id, kind, junction, pos, n, unified_pos. ``ends``: gene_id, kind (``start`` or ``end``, in genomic order), junction (the splice site next
    to the end, null for single exons), pos, n (reads).

    Input is counted per position before it comes here, so a gene's task holds its positions, not its reads.
    """
    ship_package(ends.sparkSession)

    def gene(rows: pd.DataFrame) -> pd.DataFrame:
        lo = int(rows["pos"].min())
        profile = np.bincount(rows["pos"] - lo, weights=rows["n"])
        peaks = prominent_peaks(np.log2(smooth(np.pad(profile, window), window) + 1), prominence) - window + lo
        out = rows.copy()
        for junction, part in rows.groupby("junction", dropna=False):
            out.loc[part.index, "unified_pos"] = unified(part["pos"].to_numpy(), part["n"].to_numpy(), peaks, junction, part["kind"].iloc[0] == "start")
        return out.astype({"unified_pos": "int64"})

    return ends.select("gene_id", "kind", "junction", "pos", "n").groupBy("gene_id", "kind").applyInPandas(gene, "gene_id string, kind string, junction long, pos long, n long, unified_pos long")
