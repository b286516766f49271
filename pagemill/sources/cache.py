"""Page cache: markdown kept between runs, keyed by a hash of the address.

The table is partitioned by the first two digits of the key and by the run that stored a row.
A run only ever writes its own partitions, replacing them when it is repeated, so a repeated
run adds nothing; of rows with one key the one stored last counts.  A lookup of few addresses
reads the partitions of their keys.  ``compact`` leaves one row a key.  An empty text is never
a hit, so it is not stored either.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize, url_key
from pagemill.storage import delete_folder, new_folder, write_table

CACHE_SCHEMA = "url_key string, url string, markdown string, stored_at timestamp"
PARTITIONS = "prefix string, run string"


def _prefix():
    return F.substring("url_key", 1, 2)


def cache_rows(pages: DataFrame, use_norm: bool = False) -> DataFrame:
    """``(url_key, url, markdown)`` of pages with ``url`` and a ``markdown`` text."""
    address = normalize(F.col("url")) if use_norm else F.col("url")
    stored = pages.where(F.col("markdown") != "")
    return stored.select(url_key(address).alias("url_key"), "url", "markdown")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{CACHE_SCHEMA}, {PARTITIONS}").parquet(path)
    except AnalysisException:  # nothing was stored yet
        return spark.createDataFrame([], f"{CACHE_SCHEMA}, {PARTITIONS}")


def read_cache(spark: SparkSession, path: str, asked: DataFrame | None = None, use_norm: bool = False) -> DataFrame:
    """Stored rows; with ``asked`` (pages with ``url``) only those of partitions that may hold one of them.

    There are 256 such partitions, and their names are all that the driver learns.
    """
    cache = _stored(spark, path)
    if asked is not None:
        address = normalize(F.col("url")) if use_norm else F.col("url")
        wanted = asked.select(url_key(address).alias("url_key")).select(_prefix().alias("prefix")).distinct()
        cache = cache.where(F.col("prefix").isin([r["prefix"] for r in wanted.collect()]))
    return cache.drop("prefix", "run")


def look_up(pages: DataFrame, cache: DataFrame, use_norm: bool = False) -> DataFrame:
    """``pages`` plus ``cached`` markdown (null on a miss) and the flag ``hit``.

    Of texts stored under one key the last one is taken.  Texts of other addresses are left out
    before any text is compared.
    """
    address = normalize(F.col("url")) if use_norm else F.col("url")
    keyed = pages.withColumn("url_key", url_key(address))
    asked = keyed.select("url_key").distinct()
    when = F.col("stored_at") if "stored_at" in cache.columns else F.lit(None).cast("timestamp")
    stored = (
        cache.where(F.col("markdown") != "").join(asked, "url_key", "left_semi")
        .groupBy("url_key").agg(F.max(F.struct(when.alias("at"), "markdown"))["markdown"].alias("cached"))
    )
    return (
        keyed.join(stored, "url_key", "left")
        .withColumn("hit", F.col("cached").isNotNull())
    )


def missing_from(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows not stored yet, one per key."""
    fresh = rows.join(cache.select("url_key"), "url_key", "left_anti")
    first = F.min(F.struct("url", "markdown")).alias("first")
    return fresh.groupBy("url_key").agg(first).select("url_key", "first.*")


def put(rows: DataFrame, path: str, run: str) -> None:
    """Store rows under the name of a run, in place of what that run stored before under the same digits."""
    placed = rows.select(
        "url_key", "url", "markdown", F.current_timestamp().alias("stored_at"), _prefix().alias("prefix"), F.lit(run).alias("run")
    )
    _write(placed, path)


def _write(placed: DataFrame, path: str) -> None:
    # few files for each of the partitions, whatever their size
    writer = placed.hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("prefix", "run").parquet(path)


def write_cache(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Add those of ``rows`` that are not stored yet."""
    put(missing_from(rows, read_cache(rows.sparkSession, path)), path, run or f"run-{uuid.uuid4().hex}")


def compact(spark: SparkSession, path: str) -> None:
    """Leave the newest row of every key, under one run.

    The new rows are there before the old ones go, so whoever reads meanwhile, or after a break,
    finds every key, at worst twice.
    """
    before = _stored(spark, path)
    gone = [tuple(r) for r in before.select("prefix", "run").distinct().collect()]  # partitions
    newest = before.groupBy("url_key").agg(F.max(F.struct("stored_at", "url", "markdown")).alias("r"))
    run = f"compact-{uuid.uuid4().hex}"
    kept = newest.select("url_key", "r.url", "r.markdown", "r.stored_at", _prefix().alias("prefix"), F.lit(run).alias("run"))
    _write(write_table(kept, new_folder(spark, "compact")), path)
    for prefix, run in gone:
        delete_folder(spark, f"{path}/prefix={prefix}/run={run}")


def cache_size(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("cached_pages"))
