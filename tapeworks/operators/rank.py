"""Exact, distributed row numbers within large groups.

``row_number().over(partitionBy(g).orderBy(..))`` sends a whole group to one
task. When a group is unbounded (all predictions of one split), this
operator numbers rows with a range-partitioned sort instead:

1. ``repartitionByRange(n, g, order)`` spreads every group over many
   balanced partitions (Spark samples the key distribution);
2. rows are numbered inside each (partition, group) slice;
3. a tiny table of slice sizes (``n x groups`` rows) gives each slice its
   offset via a running sum, joined back.

The result is the exact 1-based rank by (order), ties broken by the order
columns, so callers must make the order total.

The range-partitioned slices are checkpointed (one eager job) into the
session's ``spark.checkpoint.dir``: slice ids come from
``spark_partition_id()``, and a recomputation after a lost executor must see
the very same slices, which only a materialised copy guarantees. It also cuts
the lineage for the two readers (slice numbering and slice sizes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _key(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def global_row_number(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[tuple[str, bool]],
    out: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    groups = list(groups)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    ranged = (
        df.repartitionByRange(n, *[F.col(g) for g in groups], *_key(order))
        .withColumn("_slice", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    local = ranged.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy("_slice", *groups).orderBy(*_key(order)))
    )
    sizes = ranged.groupBy("_slice", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # offsets has one row per (slice, group); Spark picks the join by its size at run time
    joined = local.join(offsets, on=["_slice", *groups], how="inner")
    return joined.withColumn(out, F.col("_off") + F.col("_lrn")).drop("_slice", "_lrn", "_off")
