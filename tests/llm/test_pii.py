import hashlib
import random
import re
import time

import duckdb
import pytest

from tapeworks.llm import pii

from .conftest import edge_rows, same_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def brute(doc_id, text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return doc_id, *[sum(s[3] == k for s in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest()


COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
TRICKY = [
    "a@b.c_d@e.f x@y @z.w a@b..c a.@-.-", "1.2.3.4.5.6.7.8 0001.02.3.0255 256.1.1.1 1.2.3.99999999999999999999 00000000000000000001.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 9 4111111111111111",
    "+1 (212) 555-7890 +49 30 1234567 +1 2 +1234567890123456 ++1(((((234567890) +5 - - - ", "+1 4111 1111 1111 1111", "é😀漢 a@b.cd 😀+1 (123) 456-7890, 10.0.0.1😀", "tel a@b.c\n+4\n" * 3000, "1 " * 4000, "+1" * 500 + " 1234567890",
]


def random_text(rng):
    return "".join(rng.choice(["@", ".", "+", "-", " ", "(", ")", "1", "4", "25", "a", "Z", "_", "é", "\n", "4111111111111111", "x@y.z", "1.2.3.4", "+1 212 555 1234"]) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def tricky(spark):
    rng = random.Random(3)
    texts = [*TRICKY, *(random_text(rng) for _ in range(400))]
    rows = [*((r[0], r[1]) for r in edge_rows()), *((1000 + i, t) for i, t in enumerate(texts))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_base_equals_brute_force(tricky):
    rows, docs = tricky
    same_rows(pii.pii_table(docs).select(*COLUMNS).collect(), [brute(*r) for r in rows])


def test_sums_over_many_blocks(tricky):
    rows, _ = tricky
    assert max(sum(1 for _ in re.finditer(PATTERNS["email"], t or "")) for _, t in rows) > 2 * pii.BLOCK


def test_oracle_on_tricky_texts(tricky):
    rows, docs = tricky
    rows = [r for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1]
    want = pii.pii_table(docs.filter(docs.doc_id.isin([r[0] for r in rows]))).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = con.execute(pii.ORACLE)
    names = [d[0] for d in got.description]
    same_rows([[dict(zip(names, r))[c] for c in want[0].asDict()] for r in got.fetchall()], want)


def test_checksums_and_context_decide_added_kinds(spark):
    cases = [
        ("IBAN DE89 3704 0044 0532 0130 00.", [("iban", 95)]),
        ("IBAN DE88 3704 0044 0532 0130 00.", []),  # fails mod-97
        ("please call (212) 555-7890 now", [("phone_national", 65)]),
        ("it holds (212) 555-7890 of them", []),
        ("order call 212-555-7890", []),
        ("SSN: 123-45-6789", [("ssn", 65)]),
        ("ssn 000-45-6789, ssn 123-00-6789", []),
        ("call 10.0.0.1 or +1 212 555-7890", [("ip", 60), ("phone", 95)]),  # nothing added inside a base span
        ("host 10.0.0.1", [("ip", 85)]),
        ("version 10.0.0.1", [("ip", 35)]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = pii.find_spans(docs).collect()
    assert [[(r.kind, r.score) for r in sorted(got, key=lambda r: r.start) if r.doc_id == i] for i in range(len(cases))] == [want for _, want in cases]
    assert all(cases[r.doc_id][0][r.start : r.end] == r.value for r in got)


def test_redaction_keeps_other_columns(spark, clashing_docs):
    docs = spark.createDataFrame([(1, "mail a@b.cd, card 4111 1111 1111 1111 end", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, _base int")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "mail [email], card [card] end", 7), (2, None, 8), (3, "clean", 9)]
    out = pii.redacted(clashing_docs)
    assert out.columns == clashing_docs.columns and out.count() == clashing_docs.count()


def test_long_runs_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "9" * 500_000), (3, "1 " * 250_000), (4, "1." * 200_000), (5, "a@" * 250_000), (6, "+1" + "(" * 500_000)], "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: r for r in pii.pii_table(docs).collect()}
    assert len(got) == 6 and got[4].n_ip == 50_000 and time.time() - t < 90


def test_empty_table(no_docs):
    assert pii.pii_table(no_docs).count() == 0
