"""Landing-table readers and normalisers (SRC-3, SRC-4, SRC-6, PRJ-1, JOIN-10)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NEWS_JSONL

REQUIRED_PRICE_COLUMNS = ["date", "open", "high", "low", "close", "volume"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_optional_parquet(spark: SparkSession, path: str, columns: list[str], keys=("ticker", "date")) -> DataFrame:
    """SRC-3: a parquet table that may be absent: absent -> empty frame with the
    declared columns; declared feature columns missing from the file -> 0.0."""
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
                          + [T.StructField(c, T.DoubleType()) for c in columns])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    return df.select(*keys, *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c)
                              for c in columns])


def read_news_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: all JSONL news files of a folder; blank lines are skipped and a
    malformed line fails the read (FAILFAST). The file path is kept for order."""
    return (spark.read.schema(NEWS_JSONL).option("mode", "FAILFAST").json(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def normalise_column_name(name: str) -> str:
    """Lower case, blanks to underscores; other marks stay."""
    return re.sub(r"\s+", "_", str(name).strip().lower())


def normalise_vendor_prices(raw: DataFrame, ticker: str | None = None, categories: DataFrame | None = None) -> DataFrame:
    """SRC-6 + PRJ-1 + JOIN-10: lower/underscore column names, required columns,
    split/dividend adjustment by adj_close/close (when present), rows with missing
    OHLC dropped, ticker and category (default 'unknown') added."""
    df = raw.toDF(*[normalise_column_name(c) for c in raw.columns])
    missing = [c for c in REQUIRED_PRICE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required price columns: {missing}")
    if "adj_close" in df.columns:
        factor = F.try_divide(F.col("adj_close").try_cast("double"), F.col("close").try_cast("double"))
        df = df.select(*[(F.col(c).try_cast("double") * factor).alias(c) if c in ("open", "high", "low", "close") else F.col(c)
                         for c in df.columns])
    else:
        df = df.withColumns({c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close")})
    df = df.withColumn("volume", F.col("volume").try_cast("double"))
    if ticker is not None:
        df = df.withColumn("ticker", F.lit(ticker.upper()))
    df = df.withColumn("date", F.to_date(F.col("date").try_cast("timestamp")))
    df = df.dropna(subset=["open", "high", "low", "close"])
    if categories is not None:
        df = df.join(categories.select("ticker", "category"), "ticker", "left")
    else:
        df = df.withColumn("category", F.lit(None).cast("string"))
    return df.withColumn("category", F.coalesce(F.col("category"), F.lit("unknown")))
