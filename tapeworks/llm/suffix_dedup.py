"""Repeated byte strings by one suffix order for each anchor (operator 7).

Every byte covered by a string of ``size`` bytes that also starts elsewhere is
removed. The suffixes of one task would not fit anywhere, so strings are first
dealt by their anchors (see ``anchors``): equal strings have equal anchors at
equal places, and only segments whose anchor occurs twice or more travel, each
distinct one once with its number of occurrences.

The segments that meet at an anchor come from all shards and stand aligned at
it. No shard's suffix order or Burrows-Wheeler transform is built or merged;
segments start in input order, and from the last column to the first, the
order of the suffixes that begin at column c is the order at column c + 1,
stably dealt by the symbols at c (the LF step), and nothing is sorted anew.
Along with it goes, for neighbours, the column where their common prefix ends;
where rows are dealt apart it is the least of those passed over. A string
repeats where a neighbour's common prefix has ``size`` symbols or more.
Suffixes whose common prefixes can no longer get so long leave the order.

Defined results: a null text counts as empty; equal rows are occurrences like
any others, so both lose what they share; texts under ``size`` bytes lose
nothing; an empty table gives an empty result; texts are keyed by their 128-bit
hash, so repeated ids are no matter. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, bitmaps, hashing
from .chunks import ranges, slices
from .common import executors_tasks, stored, text_of

SIZE = 200
ANCHOR = 64
SLICE_BYTES = 2 << 20
MERGE_ROWS = 1 << 15
HOT_ROWS = 1 << 17


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 : upto + 1]) for each pair, by a table of doubling spans."""
    out = values[upto].copy()
    length = upto - after
    level, span = values, 1
    wide = np.flatnonzero(length > 1)
    while len(wide):
        # spans of up to twice ``span`` are two overlapping spans of ``span``
        now = wide[length[wide] <= 2 * span]
        out[now] = np.minimum(level[after[now] + 1], level[upto[now] - span + 1])
        wide = wide[length[wide] > 2 * span]
        level = np.minimum(level[: len(level) - span], level[span:]) if len(wide) else level
        span *= 2
    return out


def merged(rows: list[bytes], anchor_at: np.ndarray, n_starts: np.ndarray, group: np.ndarray, size: int, k: int) -> np.ndarray:
    """Which starts (columns) of each row repeat in another row of its group (sorted by group).

    Column ``size - k`` holds every row's anchor; the result has one column
    for each possible start.
    """
    n, left = len(rows), size - k
    width = left + size
    length = np.fromiter(map(len, rows), np.int64, n)
    a = left - anchor_at
    b = a + length
    table = np.zeros(n * width, np.uint8)
    table[ranges(np.arange(n) * width + a, length)] = np.frombuffer(b"".join(rows), np.uint8)
    table = np.ascontiguousarray(table.reshape(n, width).T)
    found = np.zeros((left + 1, n), bool)
    order, e = np.arange(n), np.full(n, width, np.int64)
    g = group.copy()
    for c in range(width - 1, -1, -1):
        if not len(order):
            break
        own_a, own_b = a[order], b[order]
        symbol = np.where((own_a <= c) & (c < own_b), table[c][order].astype(np.int32) + 1, 0)
        joined = g[1:] == g[:-1]
        falls = joined & (symbol[1:] < symbol[:-1])
        apart = np.append(False, (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0))
        e[apart] = np.where(falls.any(), e[apart], c)
        if falls.any():
            unsorted_groups = np.unique(g[1:][falls])
            at = np.searchsorted(unsorted_groups, g)
            moving = unsorted_groups[np.minimum(at, len(unsorted_groups) - 1)] == g
            place = np.flatnonzero(moving)
            key = at[place] * 257 + symbol[place]
            perm = np.argsort(key, kind="stable")
            key = key[perm]
            same = np.append(False, key[1:] == key[:-1])
            twin = np.flatnonzero(same)
            ends = np.full(len(place), c, np.int64)
            ends[twin] = _least_between(e[place], perm[twin - 1], perm[twin])
            order[place] = order[place][perm]
            still = np.flatnonzero(~moving)
            e[still[apart[still]]] = c
            symbol[place] = symbol[place][perm]
            e[place] = np.where(symbol[place] == 0, c, ends)
        first = np.append(True, ~joined)
        e[first] = -1
        best = np.maximum(e, np.append(e[1:], -1))
        if c <= left:
            found[c, order] = (best >= c + size) & (a[order] <= c) & (c < (a + n_starts)[order])
        if c % 8 == 0:
            live = np.flatnonzero(a[order] <= np.maximum(best, c) - size)
            if len(live) < len(order):
                e = np.minimum.reduceat(e[: live[-1] + 1], np.append(0, live[:-1] + 1)) if len(live) else e[:0]
                order, g = order[live], g[live]
                e[np.append(True, g[1:] != g[:-1])[: len(e)]] = -1
    return found.T


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    large = texts.cast(pa.large_string())
    ends = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    return np.frombuffer(large.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _repeated_anchors(texts: DataFrame, size: int, k: int, piece: int) -> DataFrame:
    """Hashes of anchors with two segments or more, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in slices(batch.column(0), SLICE_BYTES):
                h, n = np.unique(anchors.segments(*_flat(batch.column(0).slice(x, y - x)), size, k, piece)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


_SEGMENT = "k1 long, k2 long, first long, h long, c long, copies long, anchor_at long, n_starts long, content binary"


def _segments(texts: DataFrame, marked, log2: int, size: int, k: int, piece: int) -> DataFrame:
    """Two kinds of rows: occurrences (k1, k2, first, h, c), and each slice's distinct contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.binary()]

        def pack(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            for x, y in slices(batch.column(0), SLICE_BYTES):
                data, ends = _flat(batch.column(0).slice(x, y - x))
                first, n, place, h = anchors.segments(data, ends, size, k, piece)
                maybe = bitmaps.maybe_in(marked.value, h, log2) if len(h) else np.zeros(0, bool)
                first, n, place, h = first[maybe], n[maybe], place[maybe], h[maybe]
                if not len(h):
                    continue
                c = hashing.of_ranges(hashing.running(data), first, first + n + size - 1)
                row = np.searchsorted(ends, first, "right") - 1
                yield pack(len(h), k1=k1[x + row], k2=k2[x + row], first=first - ends[row], h=h.view(np.int64), c=c.view(np.int64))
                _, one, copies = np.unique(c, return_index=True, return_counts=True)
                contents = [data[s : s + m].tobytes() for s, m in zip(first[one].tolist(), (n[one] + size - 1).tolist())]
                yield pack(len(one), h=h[one].view(np.int64), c=c[one].view(np.int64), copies=copies, anchor_at=(place - first)[one], n_starts=n[one], content=contents)

    return texts.mapInArrow(run, _SEGMENT)


def _whole_anchors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, given out once ``least`` are held, up to the last value, which may go on."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= least and held[0].column(0)[0] != batch.column(0)[-1]:
            rows = pa.Table.from_batches(held)
            h = rows.column(0).to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield rows.slice(0, cut).combine_chunks()
            held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


_RUNS = "h long, c long, start long, n long"


def _merge(contents: DataFrame, size: int, k: int) -> DataFrame:
    """(h, c, start, n): runs of repeated starts in each distinct content.

    Tasks get whole anchors, sorted, and merge some ten thousand rows at a
    time; no anchor has more than ``HOT_ROWS`` here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            h, c, copies, at, n = (rows.column(i).to_numpy() for i in range(5))
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            lone = np.diff(np.append(starts, len(h)))
            group = np.repeat(np.arange(len(starts)), lone)
            several = np.flatnonzero(lone[group] > 1)
            flags = np.zeros((len(h), size - k + 1), bool)
            if len(several):
                flags[several] = merged(rows.column(5).take(pa.array(several)).to_pylist(), at[several], n[several], group[several], size, k)
            column = np.arange(size - k + 1)[None, :] - (size - k - at)[:, None]
            flags |= (copies > 1)[:, None] & (column >= 0) & (column < n[:, None])
            edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(c[row]), pa.array(begin - (size - k - at)[row]), pa.array(end - begin)], ["h", "c", "start", "n"])

        for rows in _whole_anchors(batches, MERGE_ROWS):
            yield from close(rows)

    dealt = contents.select("h", "c", "copies", "anchor_at", "n_starts", "content").repartition(executors_tasks(contents.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, _RUNS)


def _hot(contents: DataFrame, size: int) -> DataFrame:
    """The same runs for anchors with very many contents: their strings are dealt one by one.

    Each string goes by its own digest, counted within tasks first, so that an
    anchor that a third of all documents share is spread over all tasks.
    """
    strings = contents.select("h", "c", "copies", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_starts") - 1)).alias("start")).select(
        "h", "c", "copies", "start", F.md5(F.substring("content", (F.col("start") + 1).cast("int"), F.lit(size))).alias("digest")
    )
    strings = stored(strings, "hot-strings")
    often = stored(strings.groupBy("digest").agg(F.sum("copies").alias("n")).filter("n > 1").select("digest"), "hot-repeats")
    return strings.join(often, "digest").select("h", "c", "start", F.lit(1).cast("long").alias("n"))


def _cut(pairs, text: str, size: int) -> tuple[int, int, str]:
    """Bytes and maximal runs removed, and the digest of what is left."""
    data = text.encode()
    cover = np.zeros(len(data) + 1, np.int32)
    for first, end in pairs:
        cover[first] += 1
        cover[end + size - 1] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return int(gone.sum()), int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum()), hashlib.sha256(left).hexdigest()


def repeated_spans(docs: DataFrame, text_col: str = "text", size: int = SIZE, k: int = ANCHOR, piece: int = anchors.PIECE) -> DataFrame:
    """(k1, k2, spans): for texts that hold repeated strings, by their hash, runs [first, end) of starts."""
    spark = docs.sparkSession
    texts = docs.select(text_of(text_col).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    repeated = stored(_repeated_anchors(texts, size, k, piece), "anchors")
    log2 = bitmaps.log2_bits(repeated.count())
    marked = spark.sparkContext.broadcast(bitmaps.filled_cells(repeated, "h", 1, log2))
    rows = stored(_segments(texts, marked, log2, size, k, piece), "segments", compression="zstd")
    contents = rows.filter("content is not null").groupBy("h", "c", "anchor_at", "n_starts", "content").agg(F.sum("copies").alias("copies"))
    contents = stored(contents, "contents", compression="zstd")
    hot = stored(contents.groupBy("h").count().filter(F.col("count") > HOT_ROWS).select("h"), "hot-anchors")
    if hot.isEmpty():
        runs = _merge(contents, size, k)
    else:
        runs = _merge(contents.join(hot, "h", "left_anti"), size, k).unionByName(_hot(contents.join(hot, "h", "left_semi"), size))
    runs = stored(runs, "repeated-runs")
    found = rows.filter("k1 is not null").select("k1", "k2", "first", "h", "c").join(runs, ["h", "c"])
    span = F.struct((F.col("first") + F.col("start")).alias("first"), (F.col("first") + F.col("start") + F.col("n")).alias("end"))
    return found.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def cut_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = ANCHOR, piece: int = anchors.PIECE) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = stored(repeated_spans(docs, text_col, size, k, piece), "spans")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    joined = base.join(spans, ["k1", "k2"], "left").select("id", "text", F.transform("spans", lambda s: F.array(s["first"], s["end"])).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(pairs or [], text, size) if pairs else (0, 0, hashlib.sha256(text.encode()).hexdigest()) for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *(pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
