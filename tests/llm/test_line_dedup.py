import random
import re
from collections import defaultdict

import pytest

from tapeworks.llm import line_dedup

from .conftest import DOCS, edge_rows, same_rows


def brute(rows, least):
    """(doc_id, text) rows in order: lines deleted, runs and what is left."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    spoken = [[(j, x) for j, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for _, t in rows]
    seen, gone = defaultdict(int), [set() for _ in rows]
    for k in order:
        lines = [x for _, x in spoken[k]]
        for i in range(len(lines)):
            n = next((n for n in range(1, len(lines) - i + 1) if sum(map(len, lines[i : i + n])) >= least), None)
            if n:
                key = tuple(lines[i : i + n])
                if seen[key]:
                    gone[k].update(range(i, i + n))
                seen[key] += 1
    out = []
    for k, (doc_id, t) in enumerate(rows):
        runs = sum(1 for x in gone[k] if x - 1 not in gone[k])
        dead = {spoken[k][x][0] for x in gone[k]}
        left = t if not dead else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in dead)
        out.append((doc_id, len(spoken[k]), len(gone[k]), runs, left))
    return out


@pytest.mark.parametrize("least", [1, 9, 50])
def test_random_lines_equal_brute_force(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice(["a", "bb", "ccc", "", "dddd dddd", "e" * 60]) for _ in range(rng.randrange(1, 24))) for _ in range(40)]
    rows = list(enumerate(texts))
    got = line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_chars=least)
    same_rows(got.collect(), brute(rows, least))


def test_edge_rows(edge_docs):
    got = [tuple(r) for r in line_dedup.line_table(edge_docs).collect()]
    want = brute([(r[0], r[1]) for r in edge_rows()], line_dedup.MIN_CHARS)
    # rows that share an id are told apart by place only: compare them as groups
    same_rows(got, want)


def test_kept_columns_and_lost_documents(clashing_docs):
    out = line_dedup.without_later_copies(clashing_docs)
    assert out.columns == clashing_docs.columns
    texts = [r.text for r in out.collect()]
    poem = edge_rows()[15][1]
    assert texts.count(poem) == 1 and sum(poem in (t or "") for t in texts) == 1


def test_empty_and_null_tables(spark, no_docs):
    assert line_dedup.line_table(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [tuple(r) for r in line_dedup.line_table(nothing).collect()] == [(1, 0, 0, 0, None)]
    assert line_dedup.without_later_copies(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1
