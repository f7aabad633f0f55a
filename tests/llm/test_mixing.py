import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import mixing

from .conftest import edge_rows, same_rows


def brute(rows, weights, other, epochs=1.0, seed=17):
    groups = Counter(r[3] if r[3] in weights else "" for r in rows)
    w = {k: weights[k] if k else other for k in groups}
    out = Counter()
    for r in rows:
        k = r[3] if r[3] in weights else ""
        rate = epochs * len(rows) * w[k] / sum(w.values()) / groups[k]
        u = int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 16**13
        n, total, term = 0, 0.0, math.exp(-rate)
        while total + term <= u and n < 500:
            total += term
            n += 1
            term *= rate / n
        out[r] += n
    return out


@pytest.mark.parametrize("weights,other", [({"src0": 1.0, "src1": 3.0}, 1.0), ({"src2": 9.0}, 0.0), ({}, 1.0)])
def test_copies_equal_brute_force(edge_docs, weights, other):
    if not weights:
        weights = {"none such": 1.0}
    got = mixing.mix(edge_docs, weights, other)
    want = brute(edge_rows(), weights, other)
    same_rows(got.select("doc_id", "text", "lang", "source", "n_chars").collect(), [r for r in want for _ in range(want[r])])


def test_shares_near_target(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("source"), F.lit("t").alias("text"))
    n = dict(mixing.mix(docs, {"a": 1.0, "b": 1.0}, 2.0).groupBy("source").count().collect())
    total = sum(n.values())
    assert abs(total / 20000 - 1) < 0.05
    assert abs(n["a"] / total - 0.25) < 0.02 and abs(n["b"] / total - 0.25) < 0.03


def test_order_is_shuffled_and_repeatable(edge_docs):
    one = mixing.mix(edge_docs, epochs=3.0)
    keys = [[r.shuffle_key for r in part] for part in one.select("shuffle_key").rdd.glom().collect()]
    assert all(part == sorted(part) for part in keys)
    same_rows(one.select("doc_id", "copy").collect(), mixing.mix(edge_docs.repartition(7), epochs=3.0).select("doc_id", "copy").collect())


def test_columns_and_empty(clashing_docs, no_docs):
    assert mixing.mix(clashing_docs, bookkeeping=False).columns == clashing_docs.columns
    assert mixing.mix(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(no_docs.withColumn("copy", F.lit(1)))


def test_steps_reach_one():
    for rate in (0.0, 0.01, 1.0, 37.5, 900.0):
        steps = mixing.poisson_steps(rate)
        assert abs(steps[-1] - 1) < 1e-9 and steps == sorted(steps)
