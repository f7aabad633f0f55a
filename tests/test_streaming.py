"""Streams over several files, restarts, duplicates and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from tapeworks.streaming import jobs

TRADES = "ticker string, day date, n int, price double"
PREDICTIONS = ("prediction_id string, ticker string, target_date date, current_close double, predicted_close double, "
               "predicted_return double, bear_case double, bull_case double")


def bars(trades):
    return trades.groupBy("ticker", F.col("day").alias("date")).agg(F.max_by("price", "n").alias("close"))


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, TRADES).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_outcomes_of_a_day_over_several_files(spark, tmp_path):
    d = [dt.date(2024, 1, k) for k in (2, 3, 4)]
    source = tmp_path / "in"
    write(spark, [("A", d[0], 1, 10.0), ("A", d[1], 1, 11.0)], source, "part=1")
    write(spark, [("A", d[1], 2, 12.0)], source, "part=2")  # the rest of day 2
    write(spark, [("A", d[2], 1, 20.0), ("A", d[1], 3, 13.0)], source, "part=3")
    preds = spark.createDataFrame([("x", "A", d[1], 10.0, 11.0, 0.1, 9.0, 14.0), ("y", "A", d[2], 10.0, 11.0, 0.1, 9.0, 14.0)], PREDICTIONS)
    stream = lambda: spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    run = lambda: jobs.run_outcome_scoring(spark, stream(), preds, F.lit(dt.date(2024, 2, 1)), F.lit("2024-02-01 00:00:00"), bars, F.col("day"), base=str(tmp_path / "job"), final=True)
    got = {r.prediction_id: r.actual_close for r in run().collect()}
    assert got == {"x": 13.0, "y": 20.0}
    again = run().collect()  # a restart finds nothing new and scores nothing twice
    assert sorted(r.prediction_id for r in again) == ["x", "y"]


def test_the_last_day_stays_open_over_runs(spark, tmp_path):
    """A day whose trades come in two runs gives one close, and a killed micro-batch scores nothing twice."""
    d = [dt.date(2024, 1, k) for k in (2, 3, 4)]
    source = tmp_path / "in"
    write(spark, [("A", d[0], 1, 10.0), ("A", d[1], 1, 11.0)], source, "part=1")
    preds = spark.createDataFrame([("x", "A", d[1], 10.0, 11.0, 0.1, 9.0, 14.0), ("y", "A", d[2], 10.0, 11.0, 0.1, 9.0, 14.0), ("z", "A", d[0], 10.0, 11.0, 0.1, 9.0, 14.0)], PREDICTIONS)
    stream = lambda: spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    run = lambda preds, **k: jobs.run_outcome_scoring(spark, stream(), preds, F.lit(dt.date(2024, 2, 1)), F.lit("2024-02-01 00:00:00"), bars, F.col("day"), base=str(tmp_path / "job"), **k)
    closes = lambda out: {r.prediction_id: r.actual_close for r in out.collect()}
    assert closes(run(preds.filter("prediction_id <> 'z'"))) == {}
    write(spark, [("A", d[1], 2, 12.0), ("A", d[2], 1, 20.0)], source, "part=2")
    assert closes(run(preds.filter("prediction_id <> 'z'"))) == {"x": 12.0}
    write(spark, [("A", d[1], 3, 99.0)], source, "part=3")  # late: the bar changes, what is scored stays
    assert closes(run(preds)) == {"x": 12.0, "z": 10.0}  # and a prediction that came later is scored by closed days
    assert closes(run(preds, final=True)) == {"x": 12.0, "y": 20.0, "z": 10.0}


def test_a_micro_batch_reads_the_trades_of_its_own_days(spark, tmp_path):
    preds = spark.createDataFrame([], PREDICTIONS)
    read = []

    def counted(trades):
        read.append(trades.count())
        return bars(trades)

    job = jobs.OutcomeJob(spark, str(tmp_path / "t"), preds, F.lit(dt.date(2024, 2, 1)), F.lit("2024-02-01 00:00:00"), counted, F.col("day"))
    for k in range(6):
        rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=k), n, float(n)) for n in range(10)]
        job.take(spark.createDataFrame(rows, TRADES), f"batch-{k}")
    job.take(spark.createDataFrame(rows, TRADES), "batch-5")  # repeated after a crash
    assert read == [0, 10, 10, 10, 10, 10] and job.table.state()["version"] == 6


def test_copies_are_refused_however_old(spark, tmp_path):
    schema = "ticker string, published_at timestamp, title string, url string"
    t = lambda day: dt.datetime(2024, 1, day)
    source = tmp_path / "in"
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"part={k}"))
    run = lambda days: jobs.run_dedupe(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*")), days_back=days, base=str(tmp_path / "job"))
    put(0, [("A", t(1), "a", "u1"), ("A", None, "no time", "u0")])
    assert run(60).count() == 2
    put(1, [("A", t(30), "b", "u2")])
    put(2, [("A", t(1), "a", "u1"), ("A", t(2), "c", "u3"), ("A", None, "no time", "u0")])  # 29 days old, within the cut-off of 60
    assert sorted(r.title for r in run(60).collect()) == ["a", "b", "c", "no time"]


def test_daily_events_are_upserted(spark, tmp_path):
    schema = "ticker string, published_at timestamp, title string, body string"
    t = lambda day, hour: dt.datetime(2024, 1, day, hour)
    source = tmp_path / "in"
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"part={k}"))
    run = lambda: jobs.run_daily_events(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*")), base=str(tmp_path / "job"))
    put(0, [("A", t(5, 1), "strong", "x"), ("B", t(5, 1), "weak", "x")])
    put(1, [("A", t(5, 2), "weak", "y")])
    assert {(r.ticker, r.news_count) for r in run().collect()} == {("A", 2.0), ("B", 1.0)}
    put(2, [("A", t(5, 3), "lawsuit", "y")])
    out = run()
    assert {(r.ticker, r.news_count, r.lawsuit_count) for r in out.collect()} == {("A", 3.0, 1), ("B", 1.0, 0)}


def test_duplicates_and_late_rows(spark, tmp_path):
    schema = "ticker string, published_at timestamp, title string, url string"
    t = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    source = tmp_path / "in"
    for k, rows in enumerate([[("A", t(20), "a", "u1"), ("A", t(20), "a", "u1")], [("A", t(20), "a", "u1"), ("A", t(21), "b", "u2")], [("A", t(1), "late", "u3"), ("A", t(21), "b", "u2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    out = jobs.run_dedupe(spark, stream, days_back=7, base=str(tmp_path / "job"))
    assert sorted(r.title for r in out.collect()) == ["a", "b"]
