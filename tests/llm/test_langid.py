import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeworks.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.97


def test_folds_and_unknown(edge_docs, clashing_docs):
    for docs in (edge_docs, clashing_docs):
        rows = langid.identify(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (9, 10, 11, 22))
    assert by_id[13].lang_pred != "und"


def test_held_out_labels_are_never_learned(spark):
    rows = [(k, "eins zwei drei vier" if k % 2 else "one two three four", "held" if zlib.crc32(str(k).encode()) % 4 == 2 else "de" if k % 2 else "en") for k in range(80)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"de", "en"}
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in out)


def test_no_labels_one_label_and_no_rows(spark, no_docs):
    rows = [(k, "some text", None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit("xx"))).collect()} == {"xx"}
    assert langid.identify(no_docs).count() == 0


def test_codewords_differ():
    for n in (1, 2, 3, 4, 7, 8, 40):
        code = langid.codewords(n, 7)
        assert len({tuple(r) for r in code.tolist()}) == n and set(np.unique(code)) <= {-1, 1}


def test_sums_do_not_depend_on_chunks():
    import pyarrow as pa

    texts = pa.array(["abc def", "", None, "x", "yy", "zzz", "Ünï cödé " * 50, "a b c"])
    data, ends = langid.buffers(texts)
    table = np.random.default_rng(1).random((2**8 + 1, 3)).astype(np.float32)
    table[-1] = 0
    whole = [langid.summed(*langid.buffers(pa.array([t], pa.string())), table, 8)[0] for t in texts.to_pylist()]
    for chunk in (1, 2, 5, 64, 1 << 19):
        assert np.allclose(langid.summed(data, ends, table, 8, chunk), whole, atol=1e-4)
