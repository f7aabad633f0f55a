import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tapeworks.llm import warc

from .conftest import same_rows

PAGES = "page_id long, url string, html string"


def page_rows():
    big, other = "<p>ä\r\n\r\nContent-Length: 5\r\n\r\nWARC/1.1</p>" * 60, "é" * 700
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate([big, big, "small", "small", "", None, other, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, big, None])]
    return rows + [(None, "http://n", big), (None, None, "tiny"), (20, None, other), (21, "http://a\r\nb", "z" * 5000)]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        d = (h or "").encode()
        keep = max((x for x in groups[d] if x is not None), default=None)
        revisit = len(d) >= 1000 and keep is not None and i != keep
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    got = warc.round_trip(pages.withColumn("key", F.lit("clash")).withColumn("payload", F.lit(1)))
    same_rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), brute(page_rows()))


def test_archives_hold_each_payload_once(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "y" * 3000) for k in range(50)], PAGES)
    path = warc.write_archives(pages, str(tmp_path / "w"), records_per_file=7)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert text.count(b"y" * 3000) == 1 and text.count(b"WARC/1.1\r\n") == 50
    assert all(p.read_bytes().count(b"WARC/1.1\r\n") <= 7 for p in (tmp_path / "w").glob("part-*"))
    records = warc.read_archives(spark, path)
    assert {r.record_type for r in records.collect()} == {"response", "revisit"}
    assert bytes(records.filter("record_type = 'response'").first().payload) == b"y" * 3000


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
