"""The page table: what rendering an address returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return balanced(spark.read.format(fmt).schema(PAGE_SCHEMA).load(path))


def balanced(scan: DataFrame) -> DataFrame:
    """A file scan with fewer tasks than the cluster has cores, spread over all cores.

    Parsing pages is work for the CPU, and a small table may be a single row group.  A scan
    that already has a task per core passes through untouched, without a shuffle.  Only for
    plain scans: counting the tasks of a plan with joins would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def with_norm(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("norm", normalize(F.col(url)))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One ``(norm, page_id, url)`` per visit key: the lowest page id wins.

    A plain minimum, so every map task sends one row per key however hot the key is.
    """
    first = F.min(F.struct("page_id", "url")).alias("first")
    return with_norm(pages.select("page_id", "url")).groupBy("norm").agg(first).select("norm", "first.*")


def render(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """``requests`` (with ``url``) plus the html of their page; null html is a failed fetch.

    The page of each visit key is found on slim ``(norm, page_id)`` pairs; an inner join by page
    id then fetches html for those that have a page, so a short request list can be broadcast
    and the html of other pages stays where it is.
    """
    winners = distinct_pages(pages).select("norm", "page_id")
    asked = with_norm(requests).join(winners, "norm", "left")
    found = asked.where(F.col("page_id").isNotNull()).join(pages.select("page_id", "html"), "page_id")
    missing = asked.where(F.col("page_id").isNull()).withColumn("html", F.lit(None).cast("string"))
    return found.unionByName(missing)
