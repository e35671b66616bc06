"""Long spans that occur verbatim in more than one record.

Every window of ``WIDTH`` code points has one anchor: of the pieces of ``PIECE`` code points in it, the leftmost with the least hash.
Equal windows have equal anchors, so windows need to be compared only where their anchors are equal. Neighbouring windows
with one anchor form a context. Documents are streamed as contexts, each to the shard of its anchor's hash: the shard builds a compressed
FM-index of the contexts whose anchor several records have, streams them through it by backward search, and reports where the matching
statistics reach ``WIDTH`` in another record. The work grows with the text, not with shards times text. Every stretch comes from a search.

What a shard finds goes back to the flush that the context came from, which holds where it occurs; so of a text that a third of
all records hold, a shard gets one copy a flush, and no task gets its records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spliceforge.llm.fmindex import FMIndex
from spliceforge.operators.intervals import merge_intervals
from spliceforge.session import ship_package

WIDTH = 80
PIECE = 20
#: Code points looked at in one go; a longer text is looked at in parts that overlap by WIDTH - 1.
PART = 1 << 18
#: Code points of text whose contexts are packed together for the shuffle.
FLUSH = 1 << 21
#: Code points of contexts a shard is meant to hold; different contexts of one anchor that would fill it, and how often a sample must hit such an anchor.
SHARD_CHARS = 4_000_000
HOT_CONTEXTS = SHARD_CHARS // (3 * WIDTH // 2)
HOT_HITS = 50
#: Most anchors that are spread by whole windows; it bounds what the driver holds.
HOT_TRACKED = 10_000
MOST_TASKS = 50_000
#: What Spark gives as the size of a plan that it can't estimate is beyond this.
UNKNOWN_SIZE = 10**17
WINDOW_ANCHOR = 255
PACKED = pa.schema([("shard", pa.int64()), ("flush", pa.int64()), ("blob", pa.binary()), ("occurrences", pa.bool_())])
FOUND = pa.schema([("flush", pa.int64()), ("number", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])

_MULTIPLIER, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the hash's multiplier and of its inverse, modulo 2^64."""

    def __init__(self, n: int):
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n, _MULTIPLIER, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([one, np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)


def window_hashes(sums: np.ndarray, powers: Powers, width: int) -> np.ndarray:
    """Hash of the ``width`` code points from each position, given their running polynomial sums."""
    n = len(sums) - width
    return _mixed((sums[width:] - sums[:n]) * powers.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def contexts(points: np.ndarray, ends: np.ndarray, powers: Powers, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor's place in the context and hash of the anchor, of texts that lie one after the other.

    ``ends`` has the end of the text each code point is of. Windows whose anchor is in ``hot`` are contexts by themselves, with
    the whole window as anchor, so that what differs goes to different shards.
    """
    none = np.zeros(0, np.int64)
    if len(points) < WIDTH:
        return none, none, none, none.astype(np.uint64)
    weighted = _mixed(points.astype(np.uint64) + np.uint64(1)) * powers.up[: len(points)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    hashes = window_hashes(sums, powers, PIECE)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(key, WIDTH - PIECE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(ends[: len(anchor)] - np.arange(len(anchor)) >= WIDTH)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    place = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    offset, route = place[first] - start, hashes[place[first]]
    if len(hot) and (is_hot := np.isin(route, hot)).any():
        alone = ranges(start[is_hot], count[is_hot])
        whole = window_hashes(sums, powers, WIDTH)[alone]
        cold = ~is_hot
        start, count = np.concatenate([start[cold], alone]), np.concatenate([count[cold], np.ones(len(alone), np.int64)])
        offset, route = np.concatenate([offset[cold], np.full(len(alone), WINDOW_ANCHOR)]), np.concatenate([route[cold], whole])
    return start, count, offset, route


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chars(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def distinct(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct text of each of the texts in ``points``, and where each distinct one comes first."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * 4
    texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(points))])
    codes = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.full(int(codes.max()) + 1 if len(codes) else 0, len(codes), np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    return codes, first


def record_range(codes: np.ndarray, least: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, codes, least)
    np.maximum.at(high, codes, most)
    return low, high


def pack(columns: list[np.ndarray], text: bytes = b"") -> bytes:
    """Columns of one length; each by its differences, as bytes of its own type, then the text."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns) + text)


def unpack(blob: bytes, kinds: tuple) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.cumsum(np.frombuffer(raw, kind, n, at), dtype=kind).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return out, raw[at:]


#: Of a distinct context: its number in its flush, least and greatest record, windows, the anchor's place. Of an occurrence: number, record, start.
CONTEXT, OCCURRENCE = (np.int32, np.int64, np.int64, np.uint8, np.uint8), (np.int32, np.int64, np.int64)


class Packer:
    """Gathers the contexts of a partition's texts and packs them by shard, a flush of about FLUSH code points at a time.

    Equal contexts of a flush travel as one text with the range of its records; what occurs where stays with the flush.
    """

    def __init__(self, n_shards: int, hot: np.ndarray, partition: int = 0):
        self.n_shards, self.hot, self.powers = n_shards, hot, Powers(PART + WIDTH)
        self.held: list[tuple] = []
        self.size, self.flush_no = 0, partition << 32

    def parts(self, records: np.ndarray, texts: list[str]) -> Iterator[None]:
        """Adds texts of together at most PART code points, or one longer text; stops after each part."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = _points("".join(texts))
        for a in range(0, max(len(points) - WIDTH + 1, 1), PART):
            part = points[a : a + PART + WIDTH - 1]
            if len(texts) == 1:
                ends, owner, base = np.full(len(part), len(part)), np.zeros(len(part), np.int64), np.array([-a])
            else:
                ends, owner, base = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
            start, count, offset, route = contexts(part, ends, self.powers, self.hot)
            if len(start):
                who = owner[start]
                self.held.append((records[who], start - base[who], count, offset, route, part[ranges(start, count + WIDTH - 1)]))
                self.size += len(part)
            yield

    def flush(self) -> Iterator[tuple[int, int, bytes, bool]]:
        """(shard, flush, blob, False) for each shard, and one (shard, flush, blob, True) with the occurrences, whose shard is any."""
        if not self.held:
            return
        record, start, count, offset, route, points = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        flush, self.flush_no = self.flush_no, self.flush_no + 1
        lengths = count + WIDTH - 1
        begins = np.cumsum(lengths) - lengths
        codes, first = distinct(points, lengths)
        least, most = record_range(codes, record, record, len(first))
        order = np.lexsort((start, record))
        yield flush % self.n_shards, flush, pack([x[order].astype(k) for x, k in zip((codes, record, start), OCCURRENCE)]), True
        shard = (_mixed(route[first]) % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            rows = order[a:b]
            at = first[rows]
            text = _chars(points[ranges(begins[at], lengths[at])])
            columns = [x.astype(k) for x, k in zip((rows, least[rows], most[rows], count[at], offset[at]), CONTEXT)]
            yield int(shard[order[a]]), flush, pack(columns, text), False


def shared_in_shard(flushes: list[int], blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """flush, number, from, to: the stretches of a shard's contexts whose matching statistics reach WIDTH in another record."""
    parts = [unpack(b, CONTEXT) for b in blobs]
    number, least, most, count, offset = (np.concatenate([p[0][i] for p in parts]) for i in range(5))
    flush = np.repeat(np.array(flushes, np.int64), [len(p[0][0]) for p in parts])
    points = np.concatenate([_points(p[1].decode("utf-8", "surrogatepass")) for p in parts])
    del parts
    lengths = count + WIDTH - 1
    begins = np.cumsum(lengths) - lengths
    meets = _meet(points, begins, lengths, offset, least, most)
    number, least, most, flush, lengths, begins = (x[meets] for x in (number, least, most, flush, lengths, begins))
    none = np.zeros(0, np.int64)
    if not len(number):
        return none, none, none, none
    # each distinct context once, with the records of all that are like it
    codes, first = distinct(points[ranges(begins, lengths)], lengths)
    low, high = record_range(codes, least, most, len(first))
    code, a, b = _search(points, begins[first], lengths[first], low, high)
    # what holds for a context holds in every flush that has it
    by_code = np.argsort(codes, kind="stable")
    n_rows = np.bincount(codes, minlength=len(first))
    rows = by_code[ranges((np.cumsum(n_rows) - n_rows)[code], n_rows[code])]
    times = n_rows[code]
    return flush[rows], number[rows], np.repeat(a, times), np.repeat(b, times)


def _meet(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, offset: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which contexts have an anchor that several records have: what is alone with its anchor has no index to be streamed against."""
    key = np.zeros(len(begins), np.uint64)
    whole = offset == WINDOW_ANCHOR
    for rows, n, at in ((np.flatnonzero(~whole), PIECE, offset), (np.flatnonzero(whole), WIDTH, np.zeros(len(offset), np.int64))):
        place = begins[rows] + at[rows]
        hashes = np.full(len(rows), n, np.uint64)
        for k in range(n):
            hashes = hashes * np.uint64(_MULTIPLIER) + _mixed(points[place + k].astype(np.uint64) + np.uint64(1))
        key[rows] = hashes
    groups, group = np.unique(key, return_inverse=True)
    low, high = record_range(group, least, most, len(groups))
    return (low != high)[group]


def _search(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, from, to of the longest runs of windows that other records have: an FM-index of the contexts, through which each is streamed."""
    where = np.cumsum(lengths + 1) - (lengths + 1)
    symbols, dense = np.unique(points[ranges(begins, lengths)], return_inverse=True)
    text = np.zeros(int((lengths + 1).sum()), np.int64)  # 0 between the texts
    text[ranges(where, lengths)] = dense + 1
    index = FMIndex(text, len(symbols) + 1, WIDTH, np.repeat(least, lengths + 1), np.repeat(most, lengths + 1))
    found_q, found_s = [], []
    for live, at, _, shared in index.matching_statistics(where, lengths, text):
        if shared.any():
            found_q.append(live[shared])
            found_s.append(at[shared])
    if not found_q:
        none = np.zeros(0, np.int64)
        return none, none, none
    q, s = np.concatenate(found_q), np.concatenate(found_s)
    order = np.lexsort((s, q))
    q, s = q[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(q)) - 1
    return q[a], s[a], s[b] + WIDTH


def runs_of_flush(blob: bytes, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """record, from, to: the united stretches of the records of one flush, from what its contexts were found to share."""
    (code, record, start), _ = unpack(blob, OCCURRENCE)
    order = np.argsort(number, kind="stable")
    number, a, b = number[order], a[order], b[order]
    begin, end = np.searchsorted(number, code), np.searchsorted(number, code, side="right")
    times = end - begin
    rows = ranges(begin, times)
    record, low = np.repeat(record, times), np.repeat(start, times) + a[rows]
    high = np.repeat(start, times) + b[rows]
    order = np.lexsort((low, record))
    record, low, high = record[order], low[order], high[order]
    # the furthest end so far of the same record: records lie in ranges of their own
    _, rank = np.unique(record, return_inverse=True)
    far = int(high.max() + 1) if len(high) else 1
    reach = np.maximum.accumulate(high + rank * far)
    new = np.ones(len(low), bool)
    new[1:] = (low + rank * far)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1 if len(first) else first
    return record[first], low[first], (reach - rank * far)[last]


def _hot_anchors(texts: DataFrame) -> list[int]:
    """Hashes of anchors that more than about HOT_CONTEXTS different contexts have, by a sample; at most HOT_TRACKED of them.

    Only the way rows are spread depends on them, so a sample will do, and what the sketch leaves out is only spread less.
    """
    fraction = HOT_HITS / HOT_CONTEXTS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(1, np.zeros(0, np.uint64))
        for records, part in _grouped(batches):
            for _ in packer.parts(records, part):
                for _, _, count, _, route, points in packer.held:
                    lengths = count + WIDTH - 1
                    begins = np.cumsum(lengths) - lengths
                    weighted = _mixed(points.astype(np.uint64) + np.uint64(1)) * packer.powers.up[ranges(np.zeros(len(lengths), np.int64), lengths)]
                    content = np.add.reduceat(weighted, begins)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (route, content)], names=["h", "content"])
                packer.held.clear()

    different = texts.sample(fraction=fraction, seed=7).mapInArrow(emit, "h long, content long").distinct()
    top = different.selectExpr(f"approx_top_k(h, {HOT_TRACKED}, {4 * HOT_TRACKED}) as top").first()["top"] or []
    return [x["item"] for x in top if x["count"] >= HOT_HITS]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Records and texts, in groups of about PART code points; texts under WIDTH are left out."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        held, size = [], 0
        for i in range(len(texts)):
            t = texts[i].as_py()
            if t is None or len(t) < WIDTH:
                continue
            if held and size + len(t) > PART:
                yield ids[[k for k, _ in held]], [x for _, x in held]
                held, size = [], 0
            held.append((i, t))
            size += len(t)
        if held:
            yield ids[[k for k, _ in held]], [x for _, x in held]


def shared_spans(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident`` (int64), span_from, span_to: each longest run of code points that lie in a shared stretch of ``WIDTH``.

    A stretch is shared if the text of another ``ident`` holds it too. Rows with one ``ident`` count as one record (a text
    repeated under its own ident isn't shared by that); null idents and null texts give nothing, nor do texts under
    ``WIDTH``. Texts of any length are looked at whole. An empty table gives no row; extra columns aren't read. The rows of
    ``df`` must come in the same order if a lost task runs again, as those of files do; write others first.
    """
    if ident.lower() in ("span_from", "span_to"):
        raise ValueError(f"the identifier can't be named {ident}")
    spark = df.sparkSession
    ship_package(spark)
    texts = df.select(F.col(ident).cast("long").alias("__id"), F.col(text).alias("__text")).where("__id is not null and __text is not null")
    # compressed files have about as many bytes as code points; it only sets how many shards there are
    chars = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, -(-chars * 4 // SHARD_CHARS)) if chars < UNKNOWN_SIZE else 8 * wide
    hot = np.array(_hot_anchors(texts), np.int64).view(np.uint64)

    def pack_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n_shards, hot, TaskContext.get().partitionId())

        def packed() -> Iterator[pa.RecordBatch]:
            if rows := list(packer.flush()):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PACKED.types)], schema=PACKED)

        for records, part in _grouped(batches):
            for _ in packer.parts(records, part):
                if packer.size >= FLUSH:
                    yield from packed()
        yield from packed()

    def search(table: pa.Table) -> pa.Table:
        """What the contexts of a shard share, by flush and number; occurrences that lie here pass on to their flush."""
        seen = table.column("occurrences").to_numpy()
        flush, blobs = table.column("flush").to_numpy(), table.column("blob")
        mine = np.flatnonzero(~seen)
        found = shared_in_shard(flush[mine].tolist(), blobs.take(pa.array(mine)).to_pylist()) if len(mine) else (np.zeros(0, np.int64),) * 4
        here = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, FOUND.types)] + [pa.nulls(len(found[0]), pa.binary())], schema=FOUND)
        on = np.flatnonzero(seen)
        passed = [pa.array(flush[on]), *[pa.nulls(len(on), t) for t in FOUND.types[1:4]], blobs.take(pa.array(on)).combine_chunks()]
        return pa.concat_tables([here, pa.Table.from_arrays([c.cast(t) for c, t in zip(passed, FOUND.types)], schema=FOUND)])

    def expand(table: pa.Table) -> pa.Table:
        held = pc.is_valid(table.column("blob"))
        rest = table.filter(pc.invert(held))
        found = runs_of_flush(table.filter(held).column("blob")[0].as_py(), *[rest.column(c).to_numpy() for c in ("number", "a", "b")])
        return pa.table([pa.array(x, pa.int64()) for x in found], names=[ident, "span_from", "span_to"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in (ident, "span_from", "span_to")])
    # as many tasks as shards, as long as a driver can hold them, so that what a task reads doesn't grow
    packed = texts.mapInArrow(pack_contexts, "shard long, flush long, blob binary, occurrences boolean").repartition(min(n_shards, max(wide, MOST_TASKS)), "shard")
    found = packed.groupBy("shard").applyInArrow(search, "flush long, number int, a int, b int, blob binary")
    stretches = found.groupBy("flush").applyInArrow(expand, schema)
    # a record's runs are whole but where its text was cut or its ident comes again; it has no more of them than code points
    runs = merge_intervals(stretches, [ident], "span_from", "span_to", hot_rows=None)
    return runs.where("kind = 'period'").select(ident, F.col("pos_from").alias("span_from"), F.col("pos_to").alias("span_to"))
