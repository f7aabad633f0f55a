"""STR-M1 news dedupe stream, STR-M2 daily event aggregation stream,
STR-M3 matured-prediction scoring per micro-batch.

Each job reuses the batch operators on a streaming DataFrame. Output and
checkpoint stand below ``base``: a job started again with the same base
resumes where it stopped. Without one a new folder in the session's shared
checkpoint folder is taken, for a single drained run. Draining with ``trigger(availableNow=True)``
reproduces the batch result on the same input. What a job has stored are
snapshot tables (``sinks/snapshots.py``): a micro-batch that is repeated after
a crash changes nothing.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import news_events as ne
from ..session import ensure_checkpoint_dir
from ..sinks.snapshots import BUCKET, KeyedTable, KeyLog, SnapshotTable


def _paths(spark: SparkSession, name: str, base: str | None) -> tuple[str, str]:
    """Output and checkpoint of a job below ``base``; a new folder without one."""
    base = base or os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "_checkpoint")


def daily_events_stream(news_stream: DataFrame, watermark: str = "7 days") -> DataFrame:
    """STR-M2: tumbling 1-day windows per ticker with the AGG-1 aggregates
    (update mode; state older than the watermark is dropped)."""
    rows = ne.article_events(news_stream).withColumn("published_at", F.col("date").cast("timestamp"))
    aggs = (
        [F.sum(c).alias(c) for c in ne.SUM_COLS]
        + [F.avg(c).alias(c) for c in ne.MEAN_COLS]
        + [F.max(c).alias(c) for c in ne.MAX_COLS]
        + [F.min(c).alias(c) for c in ne.MIN_COLS]
    )
    return (
        rows.withWatermark("published_at", watermark)
        .groupBy("ticker", F.window("published_at", "1 day").alias("w"))
        .agg(*aggs)
        .select("ticker", F.to_date(F.col("w.start")).alias("date"), *[c for c in ne.SUM_COLS + ne.MEAN_COLS + ne.MAX_COLS + ne.MIN_COLS])
    )


def run_daily_events(spark: SparkSession, news_stream: DataFrame, watermark: str = "7 days", base: str | None = None) -> DataFrame:
    """Drain STR-M2 with ``availableNow``: each micro-batch upserts its updated
    rows by (ticker, date); returns one row per (ticker, date)."""
    out, ckpt = _paths(spark, "daily-events", base)
    rows = daily_events_stream(news_stream, watermark)
    table = KeyedTable(spark, out, ["ticker", "date"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, f"batch-{batch_id}")

    rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    stored = table.read()
    return spark.createDataFrame([], rows.schema) if stored is None else stored


def run_dedupe(spark: SparkSession, news_stream: DataFrame, days_back: int = 7, base: str | None = None) -> DataFrame:
    """STR-M1: rows whose key no earlier row has, over all micro-batches and runs.

    Keys are looked up in a key log, so a copy is refused however old it is and
    a micro-batch reads only the buckets that may hold one of its keys. Rows
    more than ``days_back`` days before the newest of earlier micro-batches are
    late (the batch job's freshness cut-off). Rows without a time are never late.
    """
    from ..functions.text import dedupe_key

    out, ckpt = _paths(spark, "news-dedupe", base)
    keyed = news_stream.withColumn("dedupe_key", dedupe_key([F.col("ticker"), F.col("published_at"), F.col("title"), F.col("url")]))
    log = KeyLog(spark, out)

    def sink(batch: DataFrame, batch_id: int) -> None:
        name, state = f"batch-{batch_id}", log.table.state()
        if state["meta"].get("last") == name:
            return
        newest = state["meta"].get("newest")
        rows = batch
        if newest is not None:
            cut = F.timestamp_seconds(F.lit(newest)) - F.expr(f"interval {days_back} days")
            rows = batch.filter(F.coalesce(F.col("published_at") >= cut, F.lit(True)))
        latest = batch.agg(F.max(F.unix_timestamp("published_at"))).first()[0]
        log.append(log.unseen(rows.dropDuplicates(["dedupe_key"])), name, {"newest": max(x for x in (newest, latest) if x is not None) if newest is not None or latest is not None else None})

    keyed.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    stored = log.read()
    return spark.createDataFrame([], keyed.schema) if stored is None else stored


class OutcomeJob:
    """STR-M3: predictions are scored when the day they are scored by is closed.

    The table below ``base`` holds trades, bars and outcomes, each dealt to
    periods of ``period_days`` days. A day is closed once a trade of a later
    day has come; the last day stays open, also from run to run, until a later
    one begins or ``close`` is told that it has ended. Then its bars are made
    from its trades, as are those of earlier days that got late trades, and
    predictions that these days can score are scored, each once. A micro-batch
    reads its own days' trades and the bars, predictions and outcomes of their
    time, not what has landed before.
    """

    def __init__(self, spark: SparkSession, base: str, predictions: DataFrame, as_of: Column, scored_at: Column, bars_fn, day: Column, tolerance_days: int = 7, period_days: int = 28):
        self.spark, self.predictions, self.as_of, self.scored_at = spark, predictions, as_of, scored_at
        self.bars_fn, self.day, self.tolerance, self.period = bars_fn, day, tolerance_days, period_days
        self.table = SnapshotTable(spark, base)

    def _bucket(self, day: Column) -> Column:
        return F.floor(F.unix_date(day) / self.period).cast("int")

    def _periods(self, first: dt.date, last: dt.date) -> range:
        number = lambda d: (d - dt.date(1970, 1, 1)).days // self.period
        return range(number(first), number(last) + 1)

    def _during(self, rows: DataFrame, column: str, first: dt.date, last: dt.date) -> DataFrame:
        return rows.filter(F.col(column).between(F.lit(first), F.lit(last)))

    def take(self, batch: DataFrame, name: str) -> None:
        """Land a micro-batch of trades and close the days before its last one."""
        state = self.table.state()
        if state["meta"].get("last") == name:
            return
        first, last = batch.agg(F.min(self.day), F.max(self.day)).first()
        if last is None:
            return  # no trade with a day
        landed = self.table.write("trades", batch.filter(self.day.isNotNull()).withColumn(BUCKET, self._bucket(self.day)), name)
        open_day = state["meta"].get("open_day")
        before = dt.date.fromisoformat(open_day) if open_day else None
        newest = max(last, before) if before else last
        touched = batch.select(self.day.alias("date")).filter(F.col("date") < F.lit(newest)).distinct()
        if before and before < newest:
            touched = touched.unionByName(self.spark.range(1).select(F.lit(before).alias("date"))).distinct()
        schemas = {"trades": batch.schema}
        self._close(state, name, touched, min(first, before) if before else first, newest - dt.timedelta(days=1), newest, schemas, landed)

    def close(self) -> None:
        """Take the open day as ended."""
        state = self.table.state()
        if state["meta"].get("open_day"):
            day = dt.date.fromisoformat(state["meta"]["open_day"])
            name = f"close-{state['version']}"
            self._close(state, name, self.spark.range(1).select(F.lit(day).alias("date")), day, day, None, {}, {})

    def catch_up(self) -> None:
        """Score what bars of closed days can score already, for predictions that are new in this run."""
        state = self.table.state()
        span = self.predictions.filter(F.col("target_date") < self.as_of).agg(F.min("target_date"), F.max("target_date")).first()
        if span[0] is not None and "bars" in state["schemas"]:
            self._commit(state, f"catch-up-{state['version']}", span[0], span[1], None, {}, {}, state["meta"].get("open_day"), {})

    def _close(self, state: dict, name: str, days: DataFrame, first: dt.date, last: dt.date, open_day: dt.date | None, schemas: dict, landed: dict) -> None:
        periods = self._periods(first, last)
        seen = {"sets": {"trades": {b: [*state["sets"].get("trades", {}).get(b, []), *landed.get(b, [])] for b in {*state["sets"].get("trades", {}), *landed}}}, "schemas": {**state["schemas"], **{k: _as_json(v) for k, v in schemas.items()}}}
        trades = self.table.read(seen, "trades", periods).withColumn("_day", self.day).join(days.withColumnRenamed("date", "_day"), "_day", "left_semi").drop("_day")
        bars = self.bars_fn(trades)
        kept = self.table.read(state, "bars", periods)
        if kept is not None:
            bars = bars.unionByName(kept.join(days, "date", "left_anti"))
        own = self.table.write("bars", bars.withColumn(BUCKET, self._bucket(F.col("date"))), name)
        schemas["bars"] = bars.schema
        self._commit(state, name, first - dt.timedelta(days=self.tolerance), last, bars.schema, own, landed, open_day.isoformat() if open_day else None, schemas)

    def _commit(self, state: dict, name: str, first: dt.date, last: dt.date, bar_schema, new_bars: dict, landed: dict, open_day: str | None, schemas: dict) -> None:
        """Score predictions with a target in ``first`` to ``last`` and commit everything of this step at once."""
        from ..plans.outcomes import score_outcomes

        until = last + dt.timedelta(days=self.tolerance)
        seen = {"sets": {"bars": {**state["sets"].get("bars", {}), **new_bars}}, "schemas": {**state["schemas"], **{k: _as_json(v) for k, v in schemas.items()}}}
        bars = self._during(self.table.read(seen, "bars", self._periods(first, until)), "date", first, until)
        due = self._during(self.predictions, "target_date", first, last)
        done = self.table.read(state, "outcomes", self._periods(first, last))
        scored = score_outcomes(due, bars, self.as_of, self.scored_at, outcomes=done, tolerance_days=self.tolerance)
        dated = scored.join(due.select("prediction_id", "target_date"), "prediction_id")
        outcomes = self.table.write("outcomes", dated.withColumn(BUCKET, self._bucket(F.col("target_date"))), name)
        self.table.commit(state, name, {**schemas, "outcomes": dated.schema}, append={"trades": landed, "outcomes": outcomes}, replace={"bars": new_bars}, meta={"open_day": open_day or state["meta"].get("open_day"), "last": name})

    def outcomes(self) -> DataFrame | None:
        stored = self.table.read(self.table.state(), "outcomes")
        return None if stored is None else stored.drop("target_date")


def _as_json(schema) -> dict:
    import json

    return json.loads(schema.json())


def run_outcome_scoring(spark: SparkSession, trade_stream: DataFrame, predictions: DataFrame, as_of: Column, scored_at: Column, bars_fn, day: Column, base: str | None = None, final: bool = False) -> DataFrame | None:
    """Drain STR-M3; with ``final`` the last day counts as ended. Returns all outcomes, None before any trade has come."""
    out, ckpt = _paths(spark, "outcomes", base)
    job = OutcomeJob(spark, out, predictions, as_of, scored_at, bars_fn, day)
    job.catch_up()
    trade_stream.writeStream.foreachBatch(lambda batch, n: job.take(batch, f"batch-{n}")).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    if final:
        job.close()
    return job.outcomes()
