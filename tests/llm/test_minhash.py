import random
import re
from collections import defaultdict

from tapeworks.llm import components, minhash

from .conftest import edge_rows, same_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """Rows (id, set size, smallest id reachable)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k_, (i, _) in enumerate(rows):
        r = find(k_)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [(i, len(s), least[find(k_)] if s else i) for k_, ((i, _), s) in enumerate(zip(rows, sets))]


def check(spark_df, rows, near):
    got = minhash.near_groups(spark_df, near=near).collect()
    want = brute(rows, near.shingle, near.percent)
    same_rows([tuple(r) for r in got], [(i, n, c, i == c) for i, n, c in want])


def test_edge_rows(edge_docs, clashing_docs):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(edge_docs, rows, minhash.Near())
    check(clashing_docs, rows, minhash.Near(shingle=5, percent=80))


def test_chains_and_mixed_buckets(spark):
    """Copies of copies: links form chains whose ends are not linked themselves."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        text = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 101, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, minhash.Near())


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows, minhash.Near())
    check(docs, rows, minhash.Near(shingle=5, percent=80))


def test_one_of_each(clashing_docs):
    out = minhash.one_of_each(clashing_docs)
    assert out.columns == clashing_docs.columns
    rows = [(r[0], r[1]) for r in edge_rows()]
    groups = {c for (i, n, c) in brute(rows, 3, 85) if n}
    wordless = sum(n == 0 for _, n, _ in brute(rows, 3, 85))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(groups) + wordless
    assert {i for i, t in got if shingles(t, 3)} == groups


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_joined_on_equal_union_find(spark):
    """Links between components, and nodes that have none yet, give what all links give at once."""
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    further = [(rng.randrange(260), rng.randrange(260)) for _ in range(60)] + [(300, 301), (301, 302)]
    root = {x: x for e in edges + further for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges + further:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    of = dict(found.collect())
    links = [(of.get(a, a), of.get(b, b)) for a, b in further]
    got = components.joined_on(found, spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len(dict(got))
    assert all(dict(got).get(x, x) == find(x) for x in root)


def test_long_words_that_sums_confuse(spark):
    """Thue-Morse words and their complements have equal running sums modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = []
    for n in (256, 512, 1024, 2048, 4096):
        one = word[:n]
        rows += [(len(rows), one), (len(rows) + 1, one.translate(str.maketrans("ab", "ba"))), (len(rows) + 2, one.upper())]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, minhash.Near())


def near_copies(n, words=150, others=40, share=0.025, seed=4):
    """Near copies of one text; many of them are not similar enough to it, but some to each other."""
    rng = random.Random(seed)
    text = [f"w{k}" for k in range(words)]
    return [(i, " ".join(f"o{k}x{rng.randrange(others)}" if rng.random() < share else w for k, w in enumerate(text))) for i in range(n)]


def test_large_group_of_near_copies(spark, monkeypatch):
    """All links of a group are found, by a number of pairs that is far from all of them."""
    met = []
    kept = minhash.stored

    def counting(df, name, **options):
        out = kept(df, name, **options)
        if name == "across":
            met.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    rows = near_copies(400) + [(1000 + i, t) for i, t in near_copies(60, others=3, share=0.06, seed=8)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, minhash.Near())
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, minhash.Near(shingle=5, percent=80))
    assert max(met) < 10 * len(rows)


def test_empty_table(no_docs):
    assert minhash.near_groups(no_docs).count() == 0 and minhash.one_of_each(no_docs).count() == 0


def test_popular_changes(spark):
    """A popular change sets most of a group apart from its reference; its members, further changed
    themselves, are linked among each other only."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        text = list(base)
        for change in range(rng.randrange(4)):  # up to three popular changes of two words each
            at = 10 + 30 * change
            text[at : at + 2] = [f"p{change}", f"q{change}"]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(100)] = rng.choice(["x", "y", f"n{i}"])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        check(df, rows, minhash.Near(percent=percent))


def test_members_known_to_be_one_component_do_not_meet(spark, monkeypatch):
    """Near copies of a text, of a part of it, and of it with a passage of their own that most of them
    share; each group is linked within itself only, or nearly so."""
    met = []
    kept = minhash.stored

    def counting(df, name, **options):
        out = kept(df, name, **options)
        if name == "across":
            met.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for start, n in ((base, 120), (base[:100], 150), (base[:120] + [f"p{k}" for k in range(40)], 150)):
        for _ in range(n):
            text = list(start)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    for near in (minhash.Near(), minhash.Near(shingle=5, percent=80)):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, near)
    assert max(met) < 5 * len(rows)  # 1,900; 8,437 when all of them met


def test_differences_that_all_members_share(spark, monkeypatch):
    """The reference has a change of its own, so all members share three differences and lacks with each
    other; most are linked neither with it nor among themselves, some with a later copy of theirs."""
    met = {}
    kept = minhash.stored

    def counting(df, name, **options):
        out = kept(df, name, **options)
        met[name] = max(met.get(name, 0), out.count()) if name in ("pivots", "across") else 0
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(2, 147, 3), 1 if i == 0 else rng.randrange(3, 7)):
            text[at] = f"n{i}x{at}"
        rows.append((i, " ".join(text)))
        if i % 20 == 0:
            text[rng.randrange(150)] = "later"
            rows.append((1000 + i, " ".join(text)))
    for near in (minhash.Near(), minhash.Near(shingle=5, percent=80)):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, near)
    assert met["across"] < len(rows) and met["pivots"] < 4 * len(rows)


def test_components_are_made_once(spark, monkeypatch):
    """Links between components start from these and not from all links anew, and few tables are written."""
    written, edges = [], []
    kept = minhash.stored

    def counting(df, name, **options):
        out = kept(df, name, **options)
        written.append(name)
        if name == "edges":
            edges.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    monkeypatch.setattr(components, "stored", counting)
    rows = near_copies(200, share=0.04)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, minhash.Near())
    first, second = edges
    assert 10 * second < first
    rounds = written.count("large-star")
    assert rounds and len(written) <= 19 + 4 * rounds


def test_words_taken_out_and_put_in(spark):
    """Sets of uneven sizes around the threshold: members with more shingles than their reference, or fewer."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text))
            kind = rng.randrange(4)
            text[at : at + rng.randrange(1, 4)] = [] if kind == 0 else [rng.choice("xyz")] if kind < 3 else ["p", "q", "r", f"n{i}"]
        if rng.random() < 0.4:
            text = text[: rng.randrange(40, 90)]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for near in (minhash.Near(percent=70), minhash.Near(), minhash.Near(shingle=5, percent=80)):
        check(df, rows, near)
