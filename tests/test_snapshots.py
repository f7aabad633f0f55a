"""Keyed tables and key logs: restarts, killed batches, copies, and what is read."""

import os

import pytest
from pyspark.sql import functions as F

from tapeworks.sinks.snapshots import KeyedTable, KeyLog, PredictionLog, SnapshotTable

SCHEMA = "k string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upserts_keep_the_latest_row_and_touch_only_their_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert t.read() is None
    want = {f"k{i}": i for i in range(50)}
    t.upsert(frame(spark, list(want.items())), "b0")
    before = t.table.state()["sets"]["rows"]
    t.upsert(frame(spark, [("k1", 100), ("new", 7)]), "b1")
    t.upsert(frame(spark, [("k1", 999)]), "b1")  # a batch that is committed already
    want |= {"k1": 100, "new": 7}
    assert {r.k: r.n for r in t.read().collect()} == want and t.read().count() == len(want)
    after = t.table.state()["sets"]["rows"]
    assert sum(after[b] != before.get(b) for b in after) <= 2


def test_reading_costs_rows_not_updates(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    for i in range(4):
        t.upsert(frame(spark, [(f"k{j}", i) for j in range(20)]), f"b{i}")
    assert len(t.read().inputFiles()) == 1 and {r.n for r in t.read().collect()} == {3}


def test_a_killed_batch_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    t.upsert(frame(spark, [("a", 1)]), "b0")
    monkeypatch.setattr(SnapshotTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.upsert(frame(spark, [("a", 2), ("b", 2)]), "b1")
    monkeypatch.undo()
    assert {r.k: r.n for r in t.read().collect()} == {"a": 1}
    t.upsert(frame(spark, [("a", 3)]), "b1")  # repeated with other rows: writes over what the killed one left
    assert {r.k: r.n for r in t.read().collect()} == {"a": 3}


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    state = t.state()
    t.commit(state, "x", {})
    with pytest.raises(RuntimeError):
        t.commit(state, "y", {})
    assert t.state()["batch"] == "x"


def test_a_new_column_is_missing_in_old_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    t.upsert(frame(spark, [("a", 1), ("b", 1)]), "b0")
    t.upsert(spark.createDataFrame([("a", 2, "x")], "k string, n int, more string"), "b1")
    assert {(r.k, r.n, r.more) for r in t.read().collect()} == {("a", 2, "x"), ("b", 1, None)}


def test_log_refuses_stored_keys_over_runs(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path / "log"), key="k", buckets=4, words=64, most_folders=2)
    stored = set()
    for run in range(4):
        rows = frame(spark, [(f"k{i}", run) for i in range(run * 30, run * 30 + 60)])
        new = log.unseen(rows)
        got = {r.k for r in new.collect()}
        assert got == {r.k for r in rows.collect()} - stored
        log.append(new, f"r{run}")
        log.append(new, f"r{run}")  # a repeated commit adds nothing
        stored |= got
    assert sorted(r.k for r in log.read().collect()) == sorted(stored)
    state = log.table.state()
    assert max(len(f) for f in state["sets"]["filter"].values()) <= 2 + 1


def test_log_reads_only_buckets_that_may_hold_a_key(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path / "log"), key="k", buckets=64, words=256)
    log.append(spark.range(4000).select(F.concat(F.lit("old"), "id").alias("k"), F.col("id").cast("int").alias("n")), "r0")
    state = log.table.state()
    size = lambda df: sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles())
    whole = size(log.stored_keys(state, range(64)))
    fresh = spark.range(300).select(F.concat(F.lit("new"), "id").alias("k"), F.lit(0).alias("n"))
    near = log.possible_buckets(state, fresh)
    assert len(near) < 16  # 300 new keys over 64 buckets, of which filters let few through
    one = log.possible_buckets(state, frame(spark, [("old17", 0)]))
    assert len(one) == 1 and size(log.stored_keys(state, one)) < whole / 20
    assert log.unseen(frame(spark, [("old17", 0), ("x", 1)])).count() == 1


def test_predictions_are_logged_once_with_their_snapshots(spark, tmp_path):
    import json

    log = PredictionLog(spark, str(tmp_path / "p"))
    features = spark.createDataFrame([("A", 1.5), ("B", None)], "ticker string, ret_5d double")
    first = spark.createDataFrame([("p1", "A", 0.02, None), (None, "X", None, "no features")], "prediction_id string, ticker string, predicted_return double, error string")
    log.append(first, features, F.lit("2024-01-02 10:00:00"), "serve-1")
    log.append(first, features, F.lit("2024-01-02 11:00:00"), "serve-2")  # served again: stored once
    wider = first.withColumn("prediction_id", F.concat("prediction_id", F.lit("b"))).withColumn("horizon", F.lit("5d"))
    log.append(wider, features, F.lit("2024-01-03 10:00:00"), "serve-3")
    log.append(first.withColumn("prediction_id", F.concat("prediction_id", F.lit("c"))), features, F.lit("2024-01-04 10:00:00"), "serve-4")  # without the newer column
    got = {r.prediction_id: r for r in log.read().collect()}
    assert sorted(got) == ["p1", "p1b", "p1c"] and str(got["p1"].created_at) == "2024-01-02 10:00:00"
    assert got["p1"].horizon is None and got["p1b"].horizon == "5d" and got["p1c"].horizon is None
    assert json.loads(got["p1"].features_json) == {"ret_5d": 1.5, "ticker": "A"} and json.loads(got["p1"].prediction_json)["predicted_return"] == 0.02


def test_a_column_cannot_change_its_type(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    t.upsert(frame(spark, [("a", 1)]), "b0")
    with pytest.raises(Exception):
        t.upsert(spark.createDataFrame([("a", "x")], "k string, n string"), "b1")
    assert t.read().count() == 1
