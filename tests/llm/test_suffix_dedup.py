import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import anchors, suffix_dedup

from .conftest import edge_rows, same_rows


def brute(rows, size):
    count = Counter(d[j : j + size] for d in ((t or "").encode() for _, t in rows) for j in range(len(d) - size + 1))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for j in range(len(d) - size + 1):
            if count[d[j : j + size]] > 1:
                gone[j : j + size] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def passages(seed, n):
    """Random texts that share passages of many lengths, some periodic."""
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice("abé ") for _ in range(m))
    shared = [word(rng.randrange(10, 140)) for _ in range(6)] + ["ab" * 60, "x" * 90]
    return [(k, word(rng.randrange(60)) + rng.choice(shared)[rng.randrange(12) :] + word(rng.randrange(60)) + rng.choice(shared)) for k in range(n)]


@pytest.mark.parametrize("hot", [1 << 17, 1])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    rows = passages(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.cut_table(docs, size=40, k=16)
    same_rows(got.collect(), brute(rows, 40))


def test_edge_rows(edge_docs, clashing_docs):
    rows = [(r[0], (r[1] or "")) for r in edge_rows()]
    want = brute(rows, 200)
    for docs in (edge_docs, clashing_docs):
        same_rows(suffix_dedup.cut_table(docs).collect(), want)


def test_rows_are_merged_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 5)
    monkeypatch.setattr(suffix_dedup.anchors, "PIECE", (1 << 11) - 1)
    rows = passages(8, 50)
    rows.append((99, "".join(t for _, t in rows)))
    same_rows(suffix_dedup.cut_table(spark.createDataFrame(rows, "doc_id long, text string"), size=30, k=12).collect(), brute(rows, 30))


@pytest.mark.parametrize("n", [2047, 2048, 9000])
def test_each_start_is_in_one_piece(n):
    data = np.random.default_rng(n).integers(97, 123, n).astype(np.uint8)
    first, count, _, h = anchors.segments(data, np.array([0, n]), 200, 64, 2047)
    starts = np.concatenate([np.arange(a, a + m) for a, m in zip(first, count)])
    assert sorted(starts) == list(range(n - 199))
    own = anchors.segments(data, np.array([0, n]), 200, 64)
    assert n > 2047 or sorted(h) == sorted(own[3])


def test_text_without_repeats_over_several_pieces(spark):
    rng = random.Random(2)
    unique = "".join(rng.choice("abcdefgh") for _ in range(9000))
    got = suffix_dedup.cut_table(spark.createDataFrame([(1, unique)], "doc_id long, text string"), piece=2047).collect()
    assert [tuple(r) for r in got] == [(1, 9000, 0, 0, hashlib.sha256(unique.encode()).hexdigest())]
    rows = [(1, unique), (2, unique[1700:2300] + "!" + unique[5000:5300]), *passages(8, 50)]
    same_rows(suffix_dedup.cut_table(spark.createDataFrame(rows, "doc_id long, text string"), piece=2047).collect(), brute(rows, 200))


def test_text_beyond_the_piece_size(spark):
    data = np.random.default_rng(6).integers(97, 123, (1 << 21) + 5000).astype(np.uint8).tobytes().decode()
    got = suffix_dedup.cut_table(spark.createDataFrame([(1, data)], "doc_id long, text string")).collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_whole_anchors_are_given_out_on_the_way(seed):
    rng = np.random.default_rng(seed)
    h = np.sort(rng.integers(-300, 300, 4000))
    h[1000:2200] = h[1000]  # one anchor over several batches
    batches = [pa.RecordBatch.from_arrays([pa.array(h[a : a + 100]), pa.array(np.arange(a, a + 100))], ["h", "row"]) for a in range(0, 4000, 100)]
    taken, closed = 0, []

    def counted():
        nonlocal taken
        for batch in [batches[0].slice(0, 0), *batches]:
            taken += batch.num_rows
            yield batch

    held = []
    for rows in suffix_dedup._whole_anchors(counted(), 500):
        held.append(taken - sum(len(x) for x in closed))
        closed.append(rows.column(0).to_numpy())
    assert len(closed) >= 5 and max(held) <= 1200 + 600
    assert (np.concatenate(closed) == h).all()
    assert all(a[-1] < b[0] for a, b in zip(closed, closed[1:]))


def test_tasks_merge_more_than_once(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 5)
    closes = spark.sparkContext.accumulator(0)
    whole = suffix_dedup._whole_anchors

    def counted(batches, least):
        for rows in whole(batches, least):
            closes.add(1)
            yield rows

    monkeypatch.setattr(suffix_dedup, "_whole_anchors", counted)
    rows = passages(8, 50)
    same_rows(suffix_dedup.cut_table(spark.createDataFrame(rows, "doc_id long, text string"), size=30, k=12).collect(), brute(rows, 30))
    assert closes.value > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_table(no_docs):
    assert suffix_dedup.cut_table(no_docs).count() == 0
