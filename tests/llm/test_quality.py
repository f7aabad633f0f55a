import re
from collections import Counter

from tapeworks.llm import quality

from .conftest import edge_rows, rows_of, same_rows

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(doc_id, text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    spoken = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)

    def bad(x):
        seps = len(re.findall(r"\s[|›»•·>/]\s", x))
        lower = x.lower()
        return (
            x.rstrip(" \t\x0b\x0c\r")[-1:] not in quality.LINE_ENDS
            or len(re.findall(quality.LINE_SYMBOLS, x)) * 20 > len(x)
            or (seps >= 2 and len(re.findall(r"[^\x20\x09-\x0D]+", x)) - seps <= 4 * (seps + 1))
            or any(p in lower for p in quality.STOCK_PHRASES)
        )

    lost, chars = sum(len(x) for x in spoken if bad(x)), sum(len(x) for x in t.split("\n"))
    return doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(spoken) - len(set(spoken)), len(covered), failed, not failed and 100 * lost <= 50 * chars


def test_counts_equal_brute_force(edge_docs):
    got = quality.quality_table(edge_docs).select(*COLUMNS).collect()
    same_rows(got, [brute(r[0], r[1]) for r in edge_rows()])


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same_rows(quality.quality_table(docs).select(*COLUMNS).collect(), [brute(r.doc_id, r.text) for r in docs.collect()])


def test_cleaning_keeps_columns_and_clean_documents(clashing_docs, edge_docs):
    out = quality.clean_documents(clashing_docs)
    assert out.columns == clashing_docs.columns
    kept = {r.doc_id for r in quality.quality_table(edge_docs).filter("kept").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept
    texts = dict(out.select("doc_id", "text").collect())
    assert texts[1] == edge_rows()[1][1]


def test_failing_lines_go(spark):
    good = "A sentence that ends as sentences do, with ten words or more."
    other = "Another line, whose words are not those before it at all."
    docs = spark.createDataFrame([(1, f"{good}\nHome | About | Shop\nAccept our cookie policy now.\nno end\n{other}\n"), (2, "no end of this line with more than ten words in it at all\n" * 1)], "doc_id long, text string")
    assert rows_of(quality.clean_documents(docs), "doc_id", "text") == [(1, f"{good}\n{other}\n")]


def test_empty_table(no_docs):
    assert quality.quality_table(no_docs).count() == 0 and quality.clean_documents(no_docs).count() == 0
