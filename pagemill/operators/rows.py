"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_with_position(
    df: DataFrame, keep: list[Column | str], array: Column, pos: str, name: str
) -> DataFrame:
    """``keep`` plus position and element; null and empty arrays give no row.

    The outer form with a filter on the position is meant: for the inner one the optimizer
    infers a size filter below the generator and evaluates ``array`` three times.  The array
    gets a projection of its own, as the analyzer is slow on large expressions in generators.
    """
    listed = df.select(*keep, array.alias("_list"))
    kept = [F.col(f"`{c}`") for c in listed.columns[:-1]]
    return listed.select(*kept, F.posexplode_outer("_list").alias(pos, name)).where(
        F.col(pos).isNotNull()
    )
