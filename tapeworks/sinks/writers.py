"""Sinks (SNK-1..11).

All writers are plain DataFrame writers; reports that must be one file are
gathered by an exchange after aggregation (they are small by construction). Row counts
for manifests come from ``DataFrame.observe`` on the same write, so no second
scan is needed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "date")) -> int:
    """SNK-1/TOP-7: range-partitioned by (ticker, date), sorted within files; returns rows."""
    obs = Observation("rows")
    # counted after the exchange: range sampling reads what stands before it twice
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).observe(obs, F.count(F.lit(1)).alias("rows"))
    out.write.mode("overwrite").parquet(path)
    return int(obs.get["rows"])


def append_jsonl(df: DataFrame, path: str) -> None:
    """SNK-2: append rows as JSON lines with columns in sorted order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """SNK-3: training sets / batch predictions as JSON lines."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """SNK-4: small reports (scorecard, backtest periods) as one CSV with header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark, payload: dict, path: str) -> None:
    """SNK-5: one-row JSON sidecar; NaN/inf are written as null."""
    def clean(v):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return v

    spark.createDataFrame([(json.dumps(clean(payload), sort_keys=True),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def append_table(df: DataFrame, path: str) -> None:
    """SNK-6/7/8: append-only parquet tables (predictions, model runs, outcomes);
    new columns are allowed (SNK-9: readers use ``mergeSchema``)."""
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


def read_table(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def failed_tickers(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """SNK-10: universe tickers with no usable bars."""
    return universe.select("ticker").join(bars.select("ticker").distinct(), "ticker", "left_anti")
