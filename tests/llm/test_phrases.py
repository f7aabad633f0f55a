import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import phrases

from .conftest import same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {q: a for q, a in c.items() if len(q) > 1 and a >= least}
        covered = {part for q, a in found.items() for part in (q[1:], q[:-1]) if found.get(part) == a}
        best = []
        for q, a in found.items():
            if q not in covered:
                score, k = min((1000 * a * n[lang] // (c[q[:k]] * c[q[k:]]), k) for k in range(1, len(q)))
                best.append((-score, -a, " ".join(q).encode(), c[q[:k]], c[q[k:]]))
        for rank, (s, a, q, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, q.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"{'Ab' if k % 3 else 'é'}{k}" for k in range(60)]
    fixed = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 8))] for _ in range(40)]
    rows = []
    for _ in range(500):
        text = ""
        for _ in range(rng.randrange(12)):
            words = rng.choice(fixed) if rng.random() < 0.6 else [vocabulary[min(rng.randrange(60), rng.randrange(60))] for _ in range(rng.randrange(1, 9))]
            text += rng.choice([" ", "\t ", "", "  "]) + " ".join(words) + rng.choice([". ", "\n", " ", ", ", "", "\x0b", "!?"])
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(None, "en"), ("", "en"), (None, None), (" \t ", "fr"), ("...", "es"), ("same same same same same same " * 300, "fr"), ("one word", "xx"), rows[0], rows[0]]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f int, phrase string").repartition(3)


@pytest.mark.parametrize("least,top,shares", [(5, 2000, ()), (4, 7, (0.1, 0.6))])
def test_equals_brute_force_whatever_the_rounds(corpus, least, top, shares):
    rows, docs = corpus
    got = phrases.mined(docs, how=phrases.Phrases(least, top, shares))
    same_rows(got.collect(), brute(rows, least, top))


def test_rounds_do_settle_languages(spark, monkeypatch):
    """Languages whose first phrases come from rare words are not read again."""
    rows = [("".join(f"p{i} q{i}. " for i in range(10)), "aa")] * 6 + [("of the. " * 50, "aa")] * 20 + [("of the. the of. " * 50, "bb")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    seen, whole = [], phrases.grown
    monkeypatch.setattr(phrases, "grown", lambda texts, *a: (seen.append({r.lang for r in texts.select("lang").distinct().collect()}), whole(texts, *a))[1])
    same_rows(phrases.mined(docs, how=phrases.Phrases(4, 2, (0.5,))).collect(), brute(rows, 4, 2))
    assert seen == [{"aa", "bb"}, {"bb"}]


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 9_000_000_000, 40_000_000_000_000, 9_000_000_001, 10_000_000_000
    row = spark.range(1).select(phrases._score(*[F.lit(x) for x in (a, n, left, right)]).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_slices_and_flushes_do_not_change_counts(corpus, monkeypatch):
    rows, _ = corpus
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for _, x in rows]), pa.array([t or "" for t, _ in rows])], ["lang", "text"])
    monkeypatch.setattr(phrases, "SLICE_BYTES", 700)
    want = Counter((x or "und", w) for t, x in rows for p in pieces(t) for w in p)
    got = Counter()
    for s in phrases.cut(iter([batch, batch.slice(3, 0)])):
        for w in s.codes:
            got[(s.lang, s.words[int(w)].as_py())] += 1
    assert got == want
    monkeypatch.setattr(phrases, "HELD_ROWS", 64)
    held, n = phrases.Counts(phrases.PHRASE), Counter()
    for s in phrases.cut(iter([batch])):
        for b in held.add(s.lang, s.words, np.bincount(s.codes, minlength=len(s.words))):
            for x in b.to_pylist():
                n[(x["lang"], x["phrase"])] += x["n"]
    for b in held.flush():
        for x in b.to_pylist():
            n[(x["lang"], x["phrase"])] += x["n"]
    assert n == want


def test_empty_table(no_docs):
    assert phrases.mined(no_docs).count() == 0
