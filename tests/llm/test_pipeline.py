import corpus_pipeline as cp
from tapeworks.llm.common import stored

from . import test_line_dedup, test_minhash, test_mixing, test_quality
from .conftest import same_rows

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = {}
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.select(*DOCUMENTS).collect()]
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == DOCUMENTS
        steps[name] = (before, [tuple(r) for r in docs.collect()])
        assert all(r[4] == len(r[1]) for r in steps[name][1])

    before, after = steps["quality_rules"]
    assert {r[0] for r in after} == {r[0] for r in before if test_quality.brute(r[0], r[1])[-1]}

    before, after = steps["line_dedup"]
    want = [(i, t) for i, n, gone, _, t in test_line_dedup.brute([r[:2] for r in before], 50) if gone == 0 or gone < n]
    same_rows([r[:2] for r in after], want)

    before, after = steps["near_dedup"]
    same_rows([(r[0],) for r in after], [(i,) for i, n, c in test_minhash.brute([r[:2] for r in before], 5, 80) if i == c])

    before, after = steps["mixing"]
    from tapeworks.llm import mixing

    copies = test_mixing.brute(before, mixing.DEFAULT_WEIGHTS, 1.0)
    same_rows(after, [r for r in copies for _ in range(copies[r])])

    name, stage = cp.STAGES[-1]
    out = stage(spark, docs, SMALL).collect()
    assert len(out) == len(after) and all(r.round_trip and r.n_pieces == len(r.piece_ids) > 0 for r in out)


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-empty")
    assert docs.count() == 0


def test_edge_rows_run_through(spark, edge_docs):
    docs = edge_docs
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-edge")
    assert docs.count() > 0
