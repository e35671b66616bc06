"""Encoding of texts by a byte-level BPE vocabulary, with forced cuts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spliceforge.session import fresh, ship_package

#: Folder of the public vocabulary files; it must exist on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: how the vocabulary's public tokenizer divides a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded fragments that a worker remembers.
REMEMBERED = 500_000


class Encoder:
    """Encodes whole Arrow columns.

    A byte pair that occurs inside no token can't be crossed by a merge, so a text may be cut there. The cut must also leave
    the tokenizer's own division of the text as it is: it is made only before the first byte of a character, not after
    white space (a run of which is divided by what follows it) and not before an apostrophe (which joins letters after it).
    Equal fragments are encoded once.
    """

    def __init__(self, folder: str, name: str):
        import tiktoken

        lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = self._cuts(ranks)
        self.known: dict[bytes, np.ndarray] = {}

    @staticmethod
    def _cuts(ranks: dict[bytes, int]) -> np.ndarray:
        """Whether a text may be cut between two bytes, at 256 * the first + the second."""
        data = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
        pairs = data[:-1] * 256 + data[1:]
        inside = np.ones(len(pairs), bool)
        inside[np.cumsum([len(t) for t in ranks])[:-1] - 1] = False  # the pair across two tokens
        free = np.ones(65536, bool)
        free[pairs[inside]] = False
        first, second = np.divmod(np.arange(65536), 256)
        free &= (second < 0x80) | (second >= 0xC0)
        free &= second != ord("'")
        # white space: ASCII, and every byte that can end a longer white-space character
        free &= ~np.isin(first, [*range(9, 14), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
        return free

    def _spans_free(self, data: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = self.cut[data[:-1].astype(np.int64) * 256 + data[1:]]
        return cut

    def _ids(self, fragment: bytes) -> np.ndarray:
        ids = self.known.get(fragment)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.known[fragment] = np.asarray(self.bpe.encode_ordinary(fragment.decode("utf-8", "replace")), np.int32)
        return ids

    def _fragments(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All fragments in order, and how many of them come before each text and at the end."""
        texts = large_texts(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        cut = self._spans_free(data)
        cut[offsets] = True
        cut[: offsets[0]] = False
        at = np.flatnonzero(cut).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), raw]) if len(at) > 1 else pa.array([], pa.large_binary())
        return parts.dictionary_encode(), np.searchsorted(at, offsets)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """list<int32> of each text's ids; null and empty texts have none."""
        parts, begins = self._fragments(texts)
        each = [self._ids(x) for x in parts.dictionary.to_pylist()]
        if not each:
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        sizes = np.array([len(x) for x in each], np.int64)
        flat, starts = np.concatenate(each), np.cumsum(sizes) - sizes
        codes = parts.indices.to_numpy()
        out = np.concatenate([[0], np.cumsum(sizes[codes])])
        source = np.repeat(starts[codes] - out[:-1], sizes[codes]) + np.arange(out[-1])
        return pa.ListArray.from_arrays(pa.array(out[begins], pa.int32()), pa.array(flat[source], pa.int32()))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        parts, begins = self._fragments(texts)
        sizes = np.array([len(self._ids(x)) for x in parts.dictionary.to_pylist()] or [0], np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[parts.indices.to_numpy()])])
        return np.diff(total[begins])


def large_texts(texts: pa.Array) -> pa.Array:
    """The texts with 64-bit offsets and without nulls' leftovers."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()).fill_null("")


@lru_cache(4)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


#: Bytes of text that are encoded at once, so that a batch of very long texts needs bounded memory.
STEP_BYTES = 4 << 20


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``STEP_BYTES`` of text, a longer text by itself."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + STEP_BYTES, "right")))
        yield a, b
        a = b


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``text`` by default) and ``ids``, an array of the ids of ``text`` without special tokens.

    Strings that look like special tokens are ordinary text; null and empty texts give an empty array. Every row of ``df``
    gives one row, in its partition: nothing is shuffled. ``ids`` must not be among the kept columns. Texts of any length
    are encoded whole.
    """
    return _mapped(df, text, ids, T.ArrayType(T.IntegerType()), keep, lambda e, t: e.encode(t), tokenizer, folder)


def count_tokens(df: DataFrame, text: str = "text", n: str = "n_tokens", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, keep: list[str] | None = None) -> DataFrame:
    """As :func:`encode_texts`, with the number of ids instead of the ids."""
    return _mapped(df, text, n, T.LongType(), keep, lambda e, t: pa.array(e.count(t), pa.int64()), tokenizer, folder)


def _mapped(df: DataFrame, text: str, name: str, kind: T.DataType, keep: list[str] | None, of, tokenizer: str, folder: str) -> DataFrame:
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{name} is a kept column already")
    ship_package(df.sparkSession)
    (t,) = fresh(keep, "text")
    rows = df.select(*keep, F.col(text).alias(t))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, kind)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, tokenizer)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(t))
            for a, b in steps(texts):
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, of(e, texts.slice(a, b - a))], names=[*keep, name])

    return rows.mapInArrow(emit, schema)
