"""DS-16 news ingestion: normalise -> freshness cut-off -> per-payload cap ->
dedupe against the stored log -> new rows + per-ticker summary
(PRJ-7, PRJ-8, TOP-6, STR-8, JOIN-9, SET-2, SNK-11).

Everything is one plan over the raw-payload table; a payload that failed to
fetch (``status`` not 2xx) becomes a failure row for its ticker while the
other tickers' rows go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedupe_key
from ..sinks.snapshots import KeyLog
from ..sources.feeds import iso_utc


def resume_from(tickers: DataFrame, ticker: str | None) -> DataFrame:
    """PRJ-8: the suffix of the ordered ticker list starting at ``ticker``.
    ``tickers`` has (position, ticker); an absent ticker gives an error row."""
    if not ticker:
        return tickers
    t = ticker.upper()
    start = tickers.filter(F.upper("ticker") == t).select(F.min("position")).scalar()
    return tickers.filter(F.col("position") >= F.coalesce(start, F.raise_error(
        F.lit(f"resume_from_ticker={t} was not found in the requested ticker list."))))


def normalise(parsed: DataFrame, min_published_at: Column, max_items: int) -> DataFrame:
    """Drop items without time, apply the freshness cut-off and keep
    the first ``max_items`` per payload (by vendor position)."""
    ok = parsed.filter(F.col("published_ts").isNotNull())
    ok = ok.withColumn("_too_old", F.col("published_ts") < min_published_at)
    fresh = ok.filter(~F.col("_too_old"))
    w = Window.partitionBy("payload_id").orderBy("position")
    capped = fresh.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_items).drop("_rank")
    return capped.select(
        "payload_id", F.upper("ticker").alias("ticker"), "position", iso_utc(F.col("published_ts")).alias("published_at"),
        "title", "body", "source", "url",
    ).withColumn("dedupe_key", dedupe_key([F.col("ticker"), F.col("published_at"), F.col("title"), F.col("url")]))


def too_old_counts(parsed: DataFrame, min_published_at: Column) -> DataFrame:
    ok = parsed.filter(F.col("published_ts").isNotNull())
    return ok.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.count_if(F.col("published_ts") < min_published_at).cast("long").alias("too_old")
    )


def new_rows(candidates: DataFrame, stored_keys: DataFrame | KeyLog | None, order: Column) -> DataFrame:
    """JOIN-9: first occurrence of each key in this run (by ``order``) that is
    not already stored. The first occurrence is found with a partial aggregate
    (min order per key), not a window, so a key copied many times costs one
    row per map task before the shuffle. A key log reads only the buckets that may
    hold one of the keys; a plain table of keys is read whole."""
    c = candidates.withColumn("_ord", order)
    first = c.groupBy("dedupe_key").agg(F.min("_ord").alias("_ord"))
    uniq = c.join(first, ["dedupe_key", "_ord"], "left_semi")
    if isinstance(stored_keys, KeyLog):
        uniq = stored_keys.unseen(uniq)
    elif stored_keys is not None:
        uniq = uniq.join(stored_keys.select("dedupe_key"), "dedupe_key", "left_anti")
    return uniq.drop("_ord")


def ingest(
    raw: DataFrame,
    parsed: DataFrame,
    stored_keys: DataFrame | KeyLog | None,
    min_published_at: Column,
    max_items: int = 8,
    ticker_order: DataFrame | None = None,
    parse_errors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """DS-16: (new rows to append, per-ticker summary).

    ``raw`` has ``status`` (HTTP-like code) per payload; ``parsed`` comes
    from a ``sources.feeds`` parser over the successful payloads, and
    ``parse_errors`` (payload_id, ticker, error) from its error reader."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(parsed.sparkSession)
    ok_ids = raw.filter(F.col("status").between(200, 299)).select("payload_id")
    # the parsed items are read by four branches (rows, counts, summary): cut the
    # lineage once into the shared checkpoint folder instead of re-parsing
    good = parsed.join(ok_ids, "payload_id", "left_semi").checkpoint(eager=True)
    cand = normalise(good, min_published_at, max_items)
    if ticker_order is not None:
        cand = cand.join(ticker_order.select(F.upper("ticker").alias("ticker"), "position").withColumnRenamed(
            "position", "_tpos"), "ticker", "left")
    else:
        cand = cand.withColumn("_tpos", F.lit(0))
    order = F.struct("_tpos", "payload_id", "position")
    fresh = new_rows(cand, stored_keys, order)
    fetched = cand.groupBy("ticker").agg(F.count(F.lit(1)).alias("fetched"))
    new = fresh.groupBy("ticker").agg(F.count(F.lit(1)).alias("new"))
    failures = raw.filter(~F.col("status").between(200, 299)).select("ticker", F.concat(F.lit("HTTP "), F.col("status").cast("string")).alias("error"))
    if parse_errors is not None:
        failures = failures.unionByName(parse_errors.join(ok_ids, "payload_id", "left_semi").select("ticker", "error"))
    failed = failures.groupBy(F.upper("ticker").alias("ticker")).agg(F.count(F.lit(1)).alias("failed_payloads"), F.min("error").alias("error"))
    tickers = raw.select(F.upper("ticker").alias("ticker")).distinct()
    summary = (
        tickers.join(fetched, "ticker", "left").join(new, "ticker", "left")
        .join(too_old_counts(good, min_published_at), "ticker", "left").join(failed, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("fetched", F.lit(0)).cast("long").alias("fetched"),
            F.coalesce("new", F.lit(0)).cast("long").alias("new"),
            (F.coalesce("fetched", F.lit(0)) - F.coalesce("new", F.lit(0))).cast("long").alias("duplicates"),
            F.coalesce("too_old", F.lit(0)).cast("long").alias("too_old"),
            F.coalesce("failed_payloads", F.lit(0)).cast("long").alias("failed_payloads"),
            "error",
        )
    )
    cols = ["ticker", "published_at", "title", "body", "source", "url", "dedupe_key"]
    return fresh.select(*cols), summary


def ingest_into(log: KeyLog, run: str, raw: DataFrame, parsed: DataFrame, min_published_at: Column, **options) -> DataFrame:
    """DS-16 with SNK-2 over runs: new rows go into the key log in one commit; returns the summary.

    A run that is repeated under its name adds nothing; one that was killed left nothing that is read.
    """
    rows, summary = ingest(raw, parsed, log, min_published_at, **options)
    held = summary.checkpoint(eager=True)  # what is new is counted before the rows are stored
    log.append(rows.dropDuplicates([log.key]), run)
    return held
