"""Driver tables and the adapter views that give them the engine's shapes.

The driver's TPC-H-like tables stand in for the reference's inputs:

* ``ohlcv``: one daily bar per (brand, ship date) from ``lineitem x part``.
  Tickers are upper-cased brands (``BRAND#7``): the engine's convention, as in
  the reference, is upper-case tickers, and news rows are upper-cased too.
* ``news``: one article per ``documents`` row, ticker and time derived from
  ``doc_id``.
* ``universe``: distinct brands; brands 1 and 2 play the two benchmarks.
* ``predictions``: one prediction per ``orders`` row.

All adapters are lazy DataFrames; filters on ``ticker``/``date`` applied by
callers are pushed into the parquet scans by Catalyst.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import bday_offset
from ..functions.numeric import confidence_label
from ..session import ensure_checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Benchmark roles in the driver data (QQQ-like and SPY-like tickers).
BENCHMARK_ROLES = {"qqq": "BRAND#1", "spy": "BRAND#2"}
N_BRANDS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-1/2: parquet scan of one driver table (schema from the footer)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars keyed (ticker, date).

    open/close are the first/last price by (order, line, part, price), packed
    into one fixed-width number, so that ``min_by``/``max_by`` run as a hash
    aggregate; a hot brand is combined map-side before the shuffle. Part is joined by Spark's own choice: AQE broadcasts it only when
    its runtime size is under the broadcast threshold.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return bars_from_lineitem(li, part)


def written_bars(bars: DataFrame, buckets: int | None = None) -> DataFrame:
    """Bars written once into the shared folder, bucketed by ticker and sorted by day.

    A plan that reads bars in several places scans this table instead of
    aggregating the trades again; windows and joins by ticker need no exchange.
    The folder stays until the cluster clears it.
    """
    spark = bars.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tapeworks_bars_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    bars.repartition(n, "ticker").write.bucketBy(n, "ticker").sortBy("ticker", "date").option("path", path).saveAsTable(name)
    return spark.table(name)


def bars_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of :func:`ohlcv`, written once."""
    return written_bars(ohlcv(spark, sf_dir))


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as a file stream (trades landing as files)."""
    path = os.path.join(sf_dir, "lineitem.parquet")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(os.path.join(sf_dir, "lineitem*.parquet"))


def bars_from_lineitem(li: DataFrame, part: DataFrame) -> DataFrame:
    """Daily bars from trade lines (see :func:`ohlcv`)."""
    order_line = F.col("l_orderkey").cast("long") * 1000 + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(10,0)")
    k = (
        order_line.cast("decimal(17,0)") * F.lit("1" + "0" * 21).cast("decimal(22,0)")
        + F.col("l_partkey").cast("decimal(11,0)") * F.lit(10**10).cast("decimal(11,0)") + cents
    ).cast("decimal(38,0)")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.upper("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min_by("l_extendedprice", k).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.max_by("l_extendedprice", k).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def coerce_ohlcv(raw: DataFrame) -> DataFrame:
    """SRC-1: cast date, coerce prices to double (bad -> NULL), drop rows with missing OHLC."""
    out = raw.select(
        F.col("ticker").cast("string").alias("ticker"),
        F.to_date("date").alias("date"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    return out.dropna(subset=["open", "high", "low", "close"])


def _doc_ticker(doc_id: Column) -> Column:
    return F.concat(F.lit("BRAND#"), ((doc_id % N_BRANDS) + 1).cast("string"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: (ticker, published_at UTC, title, body, source, url)."""
    return news_from_documents(table(spark, sf_dir, "documents"))


def news_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same articles as a file stream over the documents table."""
    path = os.path.join(sf_dir, "documents.parquet")
    schema = spark.read.parquet(path).schema
    # a file stream watches a directory: read the table file through a glob
    stream = spark.readStream.schema(schema).option("basePath", sf_dir).parquet(os.path.join(sf_dir, "documents*.parquet"))
    return news_from_documents(stream)


def news_from_documents(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "source")
    day = ((F.col("doc_id") * 7919) % 2400).cast("int")
    sec = ((F.col("doc_id") * 104729) % 86400).cast("int")
    base = F.lit("1995-01-02 00:00:00").cast("timestamp")
    published = F.timestamp_add("SECOND", sec, F.timestamp_add("DAY", day, base))
    return d.select(
        _doc_ticker(F.col("doc_id")).alias("ticker"),
        published.alias("published_at"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("body"),
        F.col("source"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, category, is_benchmark): one row per brand (bounded by brand count)."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    num = F.regexp_extract("p_brand", r"#(\d+)$", 1).cast("int")
    return p.select(
        F.upper("p_brand").alias("ticker"),
        F.concat(F.lit("cat"), (num % 4).cast("string")).alias("category"),
        num.isin(1, 2).cast("int").alias("is_benchmark"),
    )


def predictions(spark: SparkSession, sf_dir: str, horizon_days: int = 5) -> DataFrame:
    """A predictions table (one row per order) with the engine's PREDICTIONS columns."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    pred_ret = (((F.col("o_orderkey") * 7919) % 2001) - 1000).cast("double") / F.lit(10000.0)
    score = (F.col("o_orderkey") % 100).cast("double") / F.lit(100.0)
    as_of = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").cast("string").alias("prediction_id"),
        F.concat(F.lit("BRAND#"), ((F.col("o_custkey") % N_BRANDS) + 1).cast("string")).alias("ticker"),
        as_of.alias("as_of_date"),
        F.lit(f"{horizon_days}d").alias("horizon"),
        bday_offset(as_of, horizon_days).alias("target_date"),
        F.col("o_totalprice").alias("current_close"),
        pred_ret.alias("predicted_return"),
        (F.col("o_totalprice") * (F.lit(1.0) + pred_ret)).alias("predicted_close"),
        (F.col("o_totalprice") * (F.lit(1.0) + pred_ret - F.lit(0.05))).alias("bear_case"),
        (F.col("o_totalprice") * (F.lit(1.0) + pred_ret + F.lit(0.05))).alias("bull_case"),
        score.alias("confidence_score"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("string")).otherwise(confidence_label(score)).alias("confidence"),
        F.lit("synthetic").alias("model_name"),
        F.lit("v0").alias("model_version"),
    )


# ------------------------------------------------------------ raw payloads
def _xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article items as a vendor would list them, grouped into payloads of at most
    four items (one payload per ticker and block of 100 doc ids)."""
    n = news(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("page_url"))
    n = n.join(pages, n.doc_id == pages.page_id, "left")
    fmt = F.col("doc_id") % 3
    date_text = (
        F.when(fmt == 0, F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(fmt == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    )
    return n.select(
        "doc_id", "ticker", (F.col("doc_id") / 100).cast("long").alias("block"),
        F.coalesce("page_url", "url").alias("url"), "title", "source",
        F.col("body").alias("description"), date_text.alias("date"),
        F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("rfc_date"),
    )


def _payload_groups(items: DataFrame, item: Column) -> DataFrame:
    grouped = items.groupBy("ticker", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))).alias("_l"))
    pid = F.concat(F.col("ticker"), F.lit(":"), F.col("block").cast("string"))
    status = F.when(F.col("block") % 10 == 7, F.lit(500)).otherwise(F.lit(200))
    return grouped.select(pid.alias("payload_id"), "ticker", status.alias("status"),
                          F.transform("_l", lambda s: s["i"]).alias("items"),
                          F.lit("2001-12-01 00:00:00").cast("timestamp").alias("fetched_at"))


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 input: ``{status_code, headers, body: "<json text>"}`` envelopes with a
    ``news`` list; payloads of every tenth block failed (status 500)."""
    it = _feed_items(spark, sf_dir)
    g = _payload_groups(it, F.struct("title", "url", "source", "date", "description"))
    body = F.to_json(F.struct(F.col("items").alias("news")))
    env = F.to_json(F.struct(F.col("status").alias("status_code"), F.struct(F.lit("application/json").alias("content_type")).alias("headers"), body.alias("body")))
    return g.select("payload_id", "ticker", "status", env.alias("payload"), "fetched_at")


def rss_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7 input: RSS XML text per payload."""
    it = _feed_items(spark, sf_dir)
    xml_item = F.concat(
        F.lit("<item><title>"), _xml_text(F.col("title")), F.lit("</title><link>"), _xml_text(F.col("url")),
        F.lit("</link><description>"), _xml_text(F.concat(F.lit("<b>"), F.col("description"), F.lit("</b>"))),
        F.lit("</description><source>"), _xml_text(F.col("source")), F.lit("</source><pubDate>"), F.col("rfc_date"),
        F.lit("</pubDate></item>"),
    )
    g = _payload_groups(it, xml_item)
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), F.array_join("items", ""), F.lit("</channel></rss>"))
    return g.select("payload_id", "ticker", "status", xml.alias("payload"), "fetched_at")


def results_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10 input: ``{"results": [{title, url, content, published_date}]}``."""
    it = _feed_items(spark, sf_dir).withColumn("published_date", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("date")))
    g = _payload_groups(it, F.struct("title", "url", F.col("description").alias("content"), "published_date"))
    return g.select("payload_id", "ticker", "status", F.to_json(F.struct(F.col("items").alias("results"))).alias("payload"), "fetched_at")
