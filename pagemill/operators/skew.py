"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot with at least 1/HOT_KEYS of the rows.
HOT_KEYS = 200
# Items of a frequency sketch: its counts are too high by at most 3.5/TRACKED of the rows.
TRACKED = 8192
SALTS = 64


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """The most frequent keys: at most ``limit`` rows, counted with map-side combine."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.orderBy(F.desc("_rows"), F.col(key)).limit(limit).select(key)


def frequent_keys(df: DataFrame, key: str, share: int = HOT_KEYS) -> DataFrame:
    """The keys with at least ``1/share`` of the rows, from a mergeable frequency sketch.

    Every task fills a sketch of fixed size and only sketches are shuffled.  No such key is missed;
    one a little below the share may be there too, so there are fewer than ``2 * share`` rows.
    """
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(2 * share), F.lit(TRACKED))
    found = df.agg(sketch.alias("_top"), F.count(key).alias("_rows"))
    return (
        found.select(F.explode("_top").alias("_one"), "_rows")
        .where((F.col("_one.count") * share >= F.col("_rows")) & F.col("_one.item").isNotNull())
        .select(F.col("_one.item").alias(key))
    )


def salted_left_join(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Column,
    hot: DataFrame | None = None,
    salts: int = SALTS,
    also: Sequence[str] = (),
) -> DataFrame:
    """Left join ``big`` to a ``lookup`` with one row per key, hot keys spread over salts.

    With ``also`` the lookup has one row per key and those columns.  Only the rows of hot keys
    are repeated on the lookup side, ``salts`` times.  The hot list itself is the only broadcast
    and is bounded by the share that makes a key hot; the main join is left to adaptive execution, which broadcasts ``lookup`` only
    when its measured size allows.
    """
    hot = frequent_keys(big, key) if hot is None else hot
    marked = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    left = (
        big.join(marked, key, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
            .otherwise(F.lit(0)),
        )
        .drop("_hot")
    )
    right = (
        lookup.join(marked, key, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                .otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return left.join(right, [key, *also, "_salt"], "left").drop("_salt")
