import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import pieces
from tapeworks.llm.queries import tokenizer_file

from .conftest import edge_rows


@pytest.fixture(scope="module")
def model():
    return tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary(model):
    return pieces.load(model)


def tiny(words, scores):
    """A vocabulary of ``words`` after the 256 byte pieces."""
    return pieces.Vocabulary([bytes([k]) for k in range(256)] + [w.replace(pieces.MARKER, " ").encode() for w in words], np.concatenate([np.zeros(256), scores]), np.arange(256), 0, *pieces.double_array([w.encode() for w in words], list(range(256, 256 + len(words)))))


def exhaustive(v, words, scores, text, unknown):
    """The best sum of scores over all segmentations."""
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        options = [best[s] + scores[words.index(text[s:end])] for s in range(end) if s in best and text[s:end] in words]
        if text[end - 1] not in words and end - 1 in best:
            options.append(best[end - 1] + unknown)
        if options:
            best[end] = max(options)
    return best[len(text)]


def test_scores_equal_exhaustive_search():
    rng = random.Random(2)
    words = sorted({pieces.MARKER * (k % 3 == 0) + "".join(rng.choice("abé") for _ in range(1 + k % 4)) for k in range(60)} | {pieces.MARKER, pieces.MARKER * 2})
    scores = [-rng.random() * 10 for _ in words]
    u = pieces.Unigram(tiny(words, scores))
    texts = [" ".join("".join(rng.choice("abéz") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    ids, sizes, got = u.encode(pa.array(texts))
    at = 0
    for text, n, score in zip(texts, sizes, got):
        if text:
            assert score == pytest.approx(exhaustive(u.v, words, scores, pieces.MARKER + text.replace(" ", pieces.MARKER), u.unknown_score))
        assert u.decode(ids[at : at + n].tolist()) == text
        at += n


def test_both_forms_agree(vocabulary):
    u = pieces.Unigram(vocabulary)
    rng = random.Random(4)
    words = [pieces.MARKER.replace(pieces.MARKER, " ") + "".join(rng.choice("thenioaré€😀\n.") for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    ids, sizes, score = u.encode_words(words)
    at = 0
    for w, n, s in zip(words, sizes, score):
        one = u.one(w.replace(" ", pieces.MARKER).encode())
        assert ids[at : at + n].tolist() == one[0] and s == pytest.approx(one[1])
        at += n


def test_round_trip_of_edge_rows(spark, edge_docs, clashing_docs, model):
    rows = pieces.round_trip(edge_docs, model, ["doc_id"]).collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows)
    assert all(len(r.piece_ids) == r.n_pieces for r in rows)
    out = pieces.decode(pieces.encode(clashing_docs, model), model)
    assert out.columns == [*clashing_docs.columns, "piece_ids", "n_pieces", "n_fallback", "piece_score", "decoded_text"]
    assert all(r.decoded_text == (r.text or "").replace("▁", " ") for r in out.collect())
    assert [r.n_fallback for r in rows if r.doc_id == 13] == [0] and [r.n_fallback > 0 for r in rows if r.doc_id == 27] == [True]
    with pytest.raises(ValueError):
        pieces.encode(edge_docs.withColumn("piece_ids", F.lit(1)), model)


def test_empty_table(no_docs, model):
    assert pieces.round_trip(no_docs, model, ["doc_id"]).count() == 0


def test_slices_forget_chunks_without_harm(vocabulary):
    texts = pa.array([t or "" for _, t, *_ in edge_rows()] * 2)
    one = pieces.Unigram(vocabulary).encode(texts)[0]
    small, out = pieces.Unigram(vocabulary, cached_words=10), []
    for k in range(len(texts)):
        out.append(small.encode(texts.slice(k, 1))[0])
    assert np.concatenate(out).tolist() == one.tolist()
