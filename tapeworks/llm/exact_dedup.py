"""Exact deduplication with two Bloom passes (operator 3).

Pass one fills a counting Bloom filter (cells hit once, cells hit twice or
more) with the hash of every row. Pass two sends each row by the filter: a row
whose cells have not all been hit twice cannot repeat and passes straight
through; only the others are shuffled, by their full SHA-256.

Defined results: a null text counts as empty; rows of an empty table give an
empty result; of rows with equal texts the smallest id stays, a null id being
larger than any other, and of rows that also share the id exactly one. Other
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import BLANK_RUN, stored, text_of


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_log2_bits: int = bitmaps.MAX_LOG2_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``bits_per_row`` sets the filter's size and so the share of unrepeated rows
    that are shuffled for nothing (under 1 in 1,000 at 16); ``max_log2_bits``
    bounds it.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.regexp_replace(text_of(text_col), BLANK_RUN, " "), 256)
    slim = stored(
        docs.select(F.col(id_col).alias("id"), F.unhex(digest).alias("digest"))
        .withColumn("h", F.xxhash64("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "exact-digests",
    )
    log2 = bitmaps.log2_bits(slim.count(), bits_per_row, max_log2_bits)
    twice = spark.sparkContext.broadcast(bitmaps.filled_cells(slim, "h", 2, log2))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            maybe = bitmaps.maybe_in(twice.value, h, log2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

    routed = stored(slim.mapInArrow(route, f"{slim._jdf.schema().toDDL()}, maybe boolean"), "exact-routed")
    straight = routed.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    maybe = routed.filter("maybe")
    groups = stored(
        maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")),
        "exact-groups",
    ).select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    shuffled = maybe.join(groups, "digest").select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    return straight.unionByName(shuffled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (
  select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over (partition by text_sha256 order by doc_id nulls last) as n
  from d
)
select doc_id, keep_id, group_size, n = 1 as kept, text_sha256 from g
"""
