"""As-of and trailing range joins (JOIN-4/6/7) against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapeworks.operators.asof import asof_backward, asof_forward, trailing_top_n

D0 = dt.date(2024, 1, 1)


def test_same_day_counts_and_utc(spark):
    right = spark.createDataFrame([("AAA", dt.date(2026, 6, 25), 1.0), ("AAA", dt.date(2026, 6, 26), 2.0)],
                                  "ticker string, date date, v double")
    left = spark.createDataFrame([("AAA", "2026-06-26T15:52:03+00:00")], "ticker string, ts string")
    left = left.withColumn("ts", F.to_timestamp("ts"))
    out = asof_backward(left, right, ["ticker"], F.col("ts"), "date", ["v"]).collect()
    assert out[0].v == 2.0


def test_backward_and_forward_brute_force(spark):
    rnd = random.Random(7)
    bars = sorted({("T%d" % rnd.randint(0, 3), D0 + dt.timedelta(days=rnd.randint(0, 60))) for _ in range(80)})
    bar_rows = [(t, d, float(i)) for i, (t, d) in enumerate(bars)]
    probes = [(i, "T%d" % rnd.randint(0, 4), D0 + dt.timedelta(days=rnd.randint(-5, 70))) for i in range(300)]
    right = spark.createDataFrame(bar_rows, "ticker string, date date, v double")
    left = spark.createDataFrame(probes, "id int, ticker string, day date")
    back = {r.id: r.v for r in asof_backward(left, right, ["ticker"], F.col("day"), "date", ["v"]).collect()}
    fwd = {r.id: r.v for r in asof_forward(left, right, ["ticker"], F.col("day"), "date", ["v"], 7).collect()}
    for i, t, d in probes:
        cands = [(bd, v) for bt, bd, v in bar_rows if bt == t and bd <= d]
        assert back[i] == (max(cands)[1] if cands else None)
        after = [(bd, v) for bt, bd, v in bar_rows if bt == t and bd >= d]
        first = min(after) if after else None
        exp = first[1] if first and first[0] < d + dt.timedelta(days=7) else None
        assert fwd[i] == exp


def test_trailing_top_n_brute_force(spark):
    rnd = random.Random(3)
    items = [("T%d" % rnd.randint(0, 2), D0 + dt.timedelta(days=rnd.randint(0, 30)), "u%03d" % i) for i in range(200)]
    df = spark.createDataFrame(items, "ticker string, day date, url string")
    anchors = df.select("ticker", F.col("day").alias("aday")).distinct()
    out = trailing_top_n(anchors, df, ["ticker"], "aday", "day", [("day", False), ("url", True)], ["url"], 3, 7)
    got = {(r.ticker, r.aday): [x.url for x in r["items"]] for r in out.collect()}
    for (t, a), urls in got.items():
        c = sorted([(-(d.toordinal()), u) for tt, d, u in items if tt == t and a - dt.timedelta(days=7) <= d <= a])
        assert urls == [u for _, u in c[:3]]
