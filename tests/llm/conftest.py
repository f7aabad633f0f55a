import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use within.
CLASHING = ["id", "row", "h", "digest", "node", "c", "i", "line", "need", "words", "lines", "k1", "spans", "rank", "lang_pred_x"]


def words(rng, n, vocabulary=60):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(2 + k % 7)) for k in (rng.randrange(vocabulary) for _ in range(n)))


def edge_rows():
    """Nulls, empty and blank texts, a very long one, ties, copies and near copies."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(80)) + "." for _ in range(6)]
    near = base[0].replace(base[0].split()[40], "changed")
    poem = "\n".join(f"This is line {k} of a poem that many documents share, word for word." for k in range(5))
    long = " ".join(f"t{rng.randrange(900)}" for _ in range(20000)) + "."
    menu = "Home | About | Contact | Shop\n" * 4
    texts = [*base, base[0], base[1].replace(" ", "  \t"), near, "", " \n\t ", None, None, "one", "two words", poem, "Intro of its own, quite different from others.\n" + poem, poem + "\n\n" + poem,
             long, long, menu, "spam " * 120, "!!! ### $$$", "x" * 5000, "ü" * 300 + "▁ end", "a\x0bb\x0cc\rd", "<|endoftext|> in a text", "emoji 😀 and 漢字 here", "abc" * 400, "abc" * 400 + "d"]
    rows = [(k, t, None if k % 7 == 3 else "en" if k % 2 else "fr", None if k % 5 == 0 else f"src{k % 3}", None if k % 4 == 0 else len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[2], "en", "src1", 1), (None, None, None, None, None), (None, base[2], "en", "src1", 1)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    from pyspark.sql import functions as F

    return edge_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *order):
    """All rows as tuples, sorted, nulls first."""
    return sorted((tuple(r) for r in df.select(*order).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def same_rows(got, want):
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
