import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import token_files
from tapeworks.llm.queries import tokenizer_file

from .conftest import edge_rows


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_50k.json")


def expected(path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [token_files.END_ID]) for i, x in rows]


def check(got, want):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in got)
    assert [g[1] for g in got] == sorted((i for i, _ in want), key=lambda x: (x is not None, x))
    at = 0
    for start, _, n, crc, ids in got:
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += n
    assert sorted((i is not None, i or 0, ids) for _, i, _, _, ids in got) == sorted((i is not None, i or 0, ids) for i, ids in want)


@pytest.mark.parametrize("shard_tokens", [1, 700, 1 << 20])
def test_edge_rows_equal_the_library(spark, clashing_docs, path, tmp_path, shard_tokens):
    odd = ["a  b", "a   b \n c ", "  x", " ", "  ", "a b 　c d", "\n \n a\t b\x1c c \x85 d", "it's we'll 'twas", "thon's. x, y!! z?", "A1 2b ½ ² x²", "tail ", "ünïcode wörds, ok."]
    rows = [(r[0], r[1]) for r in edge_rows()] + list(enumerate(odd, 500))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    where = token_files.write_tokens(docs, str(tmp_path / "t"), path, shard_tokens=shard_tokens)
    check(token_files.read_documents(spark, where, with_ids=True).collect(), expected(path, rows))


def test_clashing_columns_and_empty(spark, clashing_docs, no_docs, path):
    assert token_files.round_trip(clashing_docs.withColumn("part", F.lit(1)), path).count() == len(edge_rows())
    assert token_files.round_trip(no_docs, path).count() == 0


def test_random_access():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 300, rng.integers(2, 9)) for _ in range(20)]
    ids = np.concatenate([phrases[rng.integers(20)] for _ in range(3000)] + [rng.integers(0, 300, 200)]).astype(np.uint32)
    rules, lengths, seq = token_files.compress(ids, 300, least=4)
    assert len(rules) > 20 and len(seq) < len(ids) / 2
    for kind, base in ((np.uint16, 300), (np.uint32, 300)):
        shard = token_files.Shard(base, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u2").tobytes())
    assert (shard.whole() == ids).all()
    for start, n in [(0, 1), (5, 0), (17, 400), (len(ids) - 3, 3), (len(ids) - 3, 50)]:
        assert shard.some(start, n).tolist() == ids[start : start + n].tolist()


@pytest.mark.parametrize("ids", [[], [1], [1, 1], [1] * 50, [1, 2] * 40, list(range(50))])
def test_small_sequences(ids):
    ids = np.array(ids, np.uint32)
    rules, lengths, seq = token_files.compress(ids, 100, least=2)
    shard = token_files.Shard(100, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u2").tobytes())
    assert shard.whole().tolist() == ids.tolist() and shard.some(0, len(ids)).tolist() == ids.tolist()


def no_pair_left(seq, least):
    pairs = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    return not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < least


def phrase_ids(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 300, rng.integers(2, 700)) for _ in range(30)]
    return np.concatenate([phrases[rng.integers(30)] for _ in range(400)] + [np.full(999, 7)]).astype(np.uint32)


def test_many_pairs_until_none_is_frequent():
    rng = np.random.default_rng(1)
    pair = rng.permutation(np.repeat(np.arange(20000), 16))
    ids = np.stack([2 * pair, 2 * pair + 1], axis=1).ravel().astype(np.uint32)
    rules, lengths, seq = token_files.compress(ids, 50257)
    assert len(rules) >= 20000 and no_pair_left(seq, 16)
    shard = token_files.Shard(50257, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes())
    assert (shard.whole() == ids).all() and shard.some(100_001, 50).tolist() == ids[100_001:100_051].tolist()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rules_a_round", [5, 4096])
def test_long_phrases_until_none_is_frequent(seed, rules_a_round):
    ids = phrase_ids(seed)
    rules, lengths, seq = token_files.compress(ids, 300, least=4, rules_a_round=rules_a_round)
    assert no_pair_left(seq, 4)
    shard = token_files.Shard(300, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(token_files._wide(300, len(rules))).tobytes())
    assert (shard.whole() == ids).all()


def test_large_symbols_give_the_same_rules():
    ids, up = phrase_ids(9), np.uint32(1 << 30)
    small, large = token_files.compress(ids, 300), token_files.compress(ids + up, 300 + (1 << 30))
    assert len(small[0]) and all((a + u == b).all() for a, b, u in zip(small, large, (up, np.uint32(0), up)))


@pytest.mark.parametrize("cached", [4, 700_000])
def test_words_are_encoded_once_whatever_marks_follow(path, cached):
    texts = ["start one two. one! two, öde?! x1. x1 ..", "öde one *** it's a'b zażółć, ɐbc. ɐbc", "", "alone", "one two " * 50, "one. two* ün. ün% \n end"]
    encoder = token_files.BpeEncoder(path, cached)
    kept, asked = encoder.after_blank.encode, []
    encoder.after_blank.encode = lambda parts: (asked.extend(parts), kept(parts))[1]
    for _ in range(2):
        for slice_ in (texts[:3], texts[3:], texts[::-1]):
            flat, sizes = encoder.encode(pa.array(slice_))
            want = [ids for _, ids in expected(path, enumerate(slice_))]
            assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    if cached > 4:
        assert len(asked) == len(set(asked)) and "one" in asked and not {"one.", "one!", "öde?!"} & set(asked)
