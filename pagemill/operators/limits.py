"""Exact first-n of a large ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import new_folder, write_table

_ROW_BITS = 33


def first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The ``n`` first rows in the order of ``order`` (a total order).

    The table is range-partitioned and sorted, each range numbers its rows, and keeps what the
    ranges before it leave of the budget; no task ever holds more than its own range, and the
    table of ranges has a row for each partition.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", _ROW_BITS))
    )
    # numbered once and read back: bounds are sampled and must not change between uses
    stored = write_table(ranged, new_folder(df.sparkSession, "ranges"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    budgets = (
        stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", (F.lit(n) - F.coalesce(before, F.lit(0))).alias("_left"))
        .where(F.col("_left") > 0)
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.join(budgets, "_range").where(row < F.col("_left")).drop("_at", "_range", "_left")
