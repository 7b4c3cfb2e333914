"""Distributed running sums in a global order (two-phase prefix sum).

A plain ``Window.orderBy`` without ``partitionBy`` moves every row into one
task.  Instead the rows are range-partitioned on (keys, order) into as many
buckets as their count asks for, each bucket is ordered inside its own window
partition, and the totals of all earlier buckets (one row per group and
bucket) are joined back as offsets.  Exactness does not depend on the ranges
being even: they only balance the buckets, and their number grows with the
data, so no bucket grows.

The input and the bucketed rows are written once each in the shared folder:
the count, the range sample, the totals and the running sums read those
tables and never the caller's plan again.  Callers collapse ties first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equitally.session import write_table

ROWS_PER_BUCKET = 1_000_000


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str], keys: list[str] = (),
                descending: bool = True, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add inclusive running sums ``cum_<c>``, group totals ``tot_<c>``, the
    group row count ``tot_rows`` and a 1-based position ``pos`` in the order
    of ``order_col`` within each ``keys`` group.

    ``order_col`` must be unique within a group (collapse ties first).
    """
    keys = list(keys)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    steps = write_table(df, "order-steps")
    n = steps.count()
    if n > rows_per_bucket:
        # bucket numbers follow the order, and are fixed by writing them
        ranged = steps.repartitionByRange(-(-n // rows_per_bucket), *[F.col(k) for k in keys], order)
        bucketed = write_table(ranged.withColumn("_bucket", F.spark_partition_id()), "order-buckets")
    else:
        bucketed = steps.withColumn("_bucket", F.lit(0))
    totals = bucketed.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_t_rows"), *[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_t_rows").over(before), F.lit(0)).alias("_o_rows"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(group).alias(f"tot_{c}") for c in sum_cols],
        F.sum("_t_rows").over(group).alias("tot_rows"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offsets hold one row per (key group, bucket): no broadcast hint, Spark
    # broadcasts them only while their measured size is under the threshold
    joined = bucketed.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        (F.col("_o_rows") + F.row_number().over(w)).alias("pos"),
        *[(F.col(f"_o_{c}") + F.sum(c).over(running)).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols], "tot_rows")
