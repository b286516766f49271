"""Seed lists: one address per line, blanks and ``#`` lines dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_SCHEMA = "seed_ord bigint, seed string"


def parse_seed_lines(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """``(seed_ord, seed)`` from raw lines; ``order`` names a line-number column.

    Without one the position in the scan is used: line order within a file, files in the
    order Spark reads them.
    """
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    position = F.monotonically_increasing_id() if order is None else F.col(order)
    return (
        lines.select(position.cast("bigint").alias("seed_ord"), text.alias("seed"))
        .where((F.col("seed") != "") & ~F.startswith(F.col("seed"), F.lit("#")))
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_lines(spark.read.text(path))


def seeds(
    spark: SparkSession, urls: Sequence[str] | DataFrame | None = None, start_url: str = ""
) -> DataFrame:
    """Seeds of a job: a list (or table) of URLs wins over a single start URL."""
    if isinstance(urls, DataFrame):
        return urls.select(F.col("seed_ord").cast("bigint").alias("seed_ord"), "seed")
    chosen = list(urls or ([start_url] if start_url else []))
    return spark.createDataFrame(list(enumerate(chosen)), SEED_SCHEMA)
