import hashlib
import re
from collections import Counter, defaultdict

from tapeworks.llm import bitmaps, exact_dedup

from .conftest import edge_rows, same_rows


def test_equals_brute_force(edge_docs, clashing_docs):
    groups = defaultdict(list)
    name = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    for r in edge_rows():
        groups[name(r[1])].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    for docs in (edge_docs, clashing_docs):
        got = exact_dedup.exact_groups(docs).collect()
        same_rows([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(r[0], least[name(r[1])], len(groups[name(r[1])]), name(r[1])) for r in edge_rows()])
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept) == set(groups) and set(kept.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_full_filter_changes_nothing(edge_docs):
    one = exact_dedup.exact_groups(edge_docs).drop("kept").collect()
    two = exact_dedup.exact_groups(edge_docs, max_log2_bits=3).drop("kept").collect()
    same_rows(one, two)


def test_filter_lets_single_rows_through(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id) as h").unionAll(spark.range(10).selectExpr("xxhash64(id) as h"))
    log2 = bitmaps.log2_bits(3010)
    twice = bitmaps.filled_cells(rows, "h", 2, log2)
    import numpy as np

    h = np.array([r.h for r in rows.collect()])
    hit = bitmaps.maybe_in(twice, h, log2)
    assert hit[-10:].all() and hit[:10].all() and hit[10:3000].mean() < 0.01


def test_empty_table(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
