"""Compressed FM-index over many short texts, searched backwards for many patterns at once.

What is kept of an index: the wavelet matrix of the Burrows-Wheeler transform (bits with counts), where each symbol's rows begin, and
two bits a row. Suffixes are sorted only while it is built; neither the suffix array nor the ranks stay. Positions are those of
the streamed texts, so nothing has to be located in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The bits below each place of a word.
MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class BitVector:
    """Bits in words of 64, with the number of set bits before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.zeros = int(len(bits) - counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & MASKS[i & 63])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def last(self, i: np.ndarray) -> np.ndarray:
        """The last set position up to i; there must be one."""
        word = i >> 6
        bits = self.words[word] & (ALL >> (63 - (i & 63)).astype(np.uint64))
        while (none := bits == 0).any():
            word = np.where(none, word - 1, word)
            bits = np.where(none, self.words[word], bits)
        high = bits >> np.uint64(32)
        return (word << 6) + np.where(high > 0, 32 + _log2(high), _log2(bits & np.uint64(0xFFFFFFFF)))

    def next(self, i: np.ndarray) -> np.ndarray:
        """The first set position from i on; there must be one."""
        word = i >> 6
        bits = self.words[word] & ~MASKS[i & 63]
        while (none := bits == 0).any():
            word = np.where(none, word + 1, word)
            bits = np.where(none, self.words[word], bits)
        return (word << 6) + _log2(bits & (~bits + np.uint64(1)))


def _log2(x: np.ndarray) -> np.ndarray:
    """Of powers of two, and rounded down of numbers below 2^53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1


class WaveletMatrix:
    """Counts of a symbol before any position of a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, BitVector]] = []
        row = symbols
        for shift in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (row >> shift) & 1
            self.levels.append((shift, BitVector(bit)))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # equal symbols end up side by side
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin[row[begins]] = begins

    def counts(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each of ``symbols`` occurs before the position of the same place in ``at``."""
        begin = self.begin[symbols]
        for shift, rank in self.levels:
            ones = rank.ones(at)
            at = np.where((symbols >> shift) & 1, ones + rank.zeros, at - ones)
        return at - begin


def suffix_rows(text: np.ndarray, n_symbols: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first 2 * ``half`` symbols (0 beyond the end), and the ranks by ``half`` and by all of them."""
    bits = max(1, int(n_symbols - 1).bit_length())
    pack = max(p for p in range(1, 64 // bits + 1) if half % p == 0 and ((half // p) & (half // p - 1)) == 0 or p == 1)
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(2 * half + pack, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(pack):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order, rank = _ranked(key)
    depth = pack
    by_half = rank if depth == half else None
    while depth < 2 * half:
        step = min(depth, 2 * half - depth) if by_half is not None else min(depth, half - depth)
        order, rank = _ranked((rank.astype(np.uint64) << np.uint64(32)) | _shifted(rank, step).astype(np.uint64))
        depth += step
        if depth == half:
            by_half = rank
    return order, by_half, rank


def _shifted(rank: np.ndarray, step: int) -> np.ndarray:
    """The rank ``step`` further on, 0 beyond the end (where only the least symbol, the separator, is left)."""
    out = np.zeros(len(rank), rank.dtype)
    if step < len(rank):
        out[:-step] = rank[step:]
    return out


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    ordered = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class FMIndex:
    """Index of texts joined by separators (symbol 0) for matches of ``width`` (even) symbols.

    ``least`` and ``most`` give for each place of ``text`` the least and the greatest record that holds the text it is in.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, width: int, least: np.ndarray, most: np.ndarray):
        order, half_rank, full_rank = suffix_rows(text, n_symbols, width // 2)
        self.n, self.width = len(text), width
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])[:n_symbols]
        # a set bit where a row's first width - 1 symbols differ from those of the row before: both halves, the second begun one earlier
        a, b = half_rank[order], _shifted(half_rank, width // 2 - 1)[order]
        cut = np.ones(self.n + 1, bool)
        cut[1 : self.n] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.cut = BitVector(cut)
        # a set bit where the rows that agree in the first width symbols are of more than one record
        whole = full_rank[order]
        opens = np.flatnonzero(np.diff(whole, prepend=0))
        several = np.minimum.reduceat(least[order], opens) != np.maximum.reduceat(most[order], opens)
        self.several = BitVector(several[whole - 1])

    def matching_statistics(self, queries: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """Streams texts through the index by backward search, from their ends to their begins.

        ``queries`` are offsets into ``text`` of texts that are in the index too. For each place of each query, from the last: (the
        queries that have such a place, the place in each, length of the match from there, whether another record has it). A match is
        followed no further than ``width``, the threshold: its last symbol is dropped before the next is put in front. What another
        record has is only asked at that length, and is False below.
        """
        sp, ep = np.zeros(len(queries), np.int64), np.full(len(queries), self.n, np.int64)
        live = np.arange(len(queries))
        for t in range(int(lengths.max()) if len(lengths) else 0):
            on = lengths[live] > t
            if not on.all():
                live, sp, ep = live[on], sp[on], ep[on]
            at = lengths[live] - 1 - t
            symbol = text[queries[live] + at]
            if t >= self.width:
                sp, ep = self.cut.last(sp), self.cut.next(ep)
            # what has one row goes to one row, as it is in the index
            wide = np.flatnonzero(ep - sp > 1)
            counts = self.wavelet.counts(np.concatenate([symbol, symbol[wide]]), np.concatenate([sp, ep[wide]]))
            base = self.first[symbol]
            sp = base + counts[: len(sp)]
            ep = sp + 1
            ep[wide] = base[wide] + counts[len(sp) :]
            length = min(t + 1, self.width)
            yield live, at, length, self.several.get(sp) if length == self.width else np.zeros(len(live), bool)

    def nbytes(self) -> int:
        """What the index takes."""
        vectors = [v for _, v in self.wavelet.levels] + [self.cut, self.several]
        return sum(v.words.nbytes + v.before.nbytes for v in vectors) + self.first.nbytes + self.wavelet.begin.nbytes
