import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import negatives

from .conftest import same_rows

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100):
    def q(v):
        return [math.floor(256 * x) if abs(x) < 2**500 else 256 * int(x) for x in v]

    taking = [(i, (n + 1) % 10 if i % 7 == 0 else n, q(v)) for i, v, n in rows if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, n, v in {(i, n, tuple(v)) for i, n, v in taking if i % every == 0}:
        scored = sorted(((-score(v, w), j, m) for j, m, w in taking if j != a))
        for ps, p, _ in [x for x in scored if x[2] == n][:5]:
            near = [x for x in scored if x[2] != n and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:5]
            out += [(a, p, k + 1, j, -ps, -s) for k, (s, j, _) in enumerate(near)]
    return out


def unit(rng, dims=12):
    v = [rng.gauss(0, 1) for _ in range(dims)]
    return [x / math.sqrt(sum(y * y for y in v)) for x in v]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(11)
    centres = [unit(rng) for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[rng.randrange(6)]], rng.randrange(10)) for i in range(700)]
    rows += [(700 + i, centres[0], i % 3) for i in range(60)]  # ties
    rows += [(800, None, 1), (801, [0.1, None], 1), (802, [float("nan")] * 12, 1), (803, [float("inf")] * 12, 2), (None, centres[1], 1), (900, centres[1], None), (805, [], 2), (1000, [], 3)]
    rows += [(1100, centres[2][:5], 4), (1101, centres[2] + [0.5, 0.5], 5), rows[5], rows[5], rows[200], rows[200], (300, centres[3], 7)]
    return rows


def test_equals_brute_force(spark, mixed):
    got = negatives.negatives_table(spark.createDataFrame(mixed, SCHEMA).repartition(5))
    same_rows(got.collect(), brute(mixed))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_wide_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [x * 2.0**50 if i % 3 else x * 3e5 for x in unit(rng, 4)], i % 2) for i in range(120)]
    want = [(a, p, k, n, max(-(2**63), min(2**63 - 1, ps)), max(-(2**63), min(2**63 - 1, ns))) for a, p, k, n, ps, ns in brute(rows, 40)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), negatives.relabelled(), mining=negatives.Mining(every=40))
    same_rows(got.collect(), want)


def test_numbers_past_the_doubles_do_not_break_it(spark):
    rows = [(i, [1e306 * (1 if i % 2 else -1), float(i)], i % 2) for i in range(0, 120)]
    assert negatives.negatives_table(spark.createDataFrame(rows, SCHEMA)).count() >= 0


def test_packed_products_equal_numpy():
    rng = np.random.default_rng(2)
    for dims, high in ((64, 600), (3, 2**31), (700, 40)):
        rows, anchor = rng.integers(-high, high, (50, dims)), rng.integers(-high, high, dims)
        packed = negatives.Packed(rows, int(anchor.max() - anchor.min()))
        assert [int(x) for x in packed.scores(anchor.tolist(), int(anchor.min()))] == [sum(int(x) * int(y) for x, y in zip(r, anchor)) for r in rows]


def test_one_group_of_equal_vectors_is_cut_before_the_exchange(spark):
    docs = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("label"), F.lit(1).alias("ids"), F.lit(2).alias("block"))
    rows = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]
    out = negatives.negatives_table(docs)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    same_rows(out.collect(), brute(rows))


def test_empty_table_and_no_anchors(spark):
    assert negatives.negatives_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.negatives_table(spark.createDataFrame([(1, [0.5], 2)], SCHEMA)).count() == 0
