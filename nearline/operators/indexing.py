"""Distributed dense row numbering (used by M1, M8, S4, K1).

A window without ``partitionBy`` would move every row to one task.  Instead the
rows are range-partitioned on the order keys, numbered inside each partition
with ``monotonically_increasing_id`` (partition id in the upper bits, local
position in the lower 33 bits), and shifted by the running total of the
per-partition counts.  The counts table has one row per partition, so the only
single-task step and the broadcast are bounded by the partition count.

The range-partitioned rows are written to the shared checkpoint folder
before they are counted: range bounds come from a sample whose outcome depends
on the arrival order of shuffled rows, so two independent evaluations could
disagree.  The stored copy fixes one evaluation, cuts the lineage, and lets a
lost executor be replaced without recomputing the numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.session import materialize


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(df: DataFrame, key: str = "_nl_row") -> DataFrame:
    """``df`` stored with a number of each row, so that rows of repeated or missing ids stay apart.

    The number is fixed with the stored copy; it is unique, not dense.
    """
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")


def with_global_index(df: DataFrame, order_cols: list, idx_col: str = "idx",
                      num_partitions: int | None = None, with_total: str | None = None) -> DataFrame:
    """Add a 0-based BIGINT position under ``order_cols`` (which must be unique).

    ``with_total`` names an optional column holding the total row count.
    """
    n = _num_partitions(df, num_partitions)
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = (ordered.withColumn("_nl_mid", F.monotonically_increasing_id())
              .withColumn("_nl_pid", F.shiftright(F.col("_nl_mid"), 33)))
    tagged = materialize(tagged, "ordered")
    counts = tagged.groupBy("_nl_pid").agg(F.count(F.lit(1)).alias("_nl_cnt"))
    w = Window.orderBy("_nl_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["_nl_pid", F.coalesce(F.sum("_nl_cnt").over(w), F.lit(0)).alias("_nl_off")]
    if with_total:
        cols.append(F.sum("_nl_cnt").over(Window.partitionBy(F.lit(1))).cast("bigint").alias(with_total))
    offsets = counts.select(*cols)
    out = tagged.join(F.broadcast(offsets), "_nl_pid")
    local = F.col("_nl_mid") - F.shiftleft(F.col("_nl_pid"), 33)
    return (out.withColumn(idx_col, (F.col("_nl_off") + local).cast("bigint"))
            .drop("_nl_mid", "_nl_pid", "_nl_off"))
