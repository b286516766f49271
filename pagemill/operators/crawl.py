"""Breadth-first crawl over a page table.

One Spark job per depth level.  Every level is written under the run folder and read back,
which cuts lineage, survives lost executors and is what a later run resumes from.  Page
html is read once, to build a slim index (links and a blank flag per visit key); levels
join that index and never touch html again.

Index and levels are tables bucketed and sorted by the visit key, so neither is ever shuffled:
of a level only the requests are, once (and to their hosts and back where robots rules hold).
A level finds its pages in the columns of the index that say whether there is one; links stay
in the index and are joined, bucket by bucket, when the next level is asked for.

Visiting order is that of a first-in-first-out queue.  A request carries its rank as an
array, ``[0 seed | 1 sitemap, seed number, position in sitemap, link position, …]``, and
arrays compare element by element, so the least rank is the first in the queue and no
global numbering is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.binding import let
from pagemill.functions.links import base_url, dom_hrefs, dom_onclick_targets
from pagemill.functions.markup import is_blank_page, strip_raw
from pagemill.functions.urls import domain_key, in_scope, is_junk, normalize, resolve_all
from pagemill.operators.limits import first_n
from pagemill.operators.robots import with_verdict
from pagemill.operators.rows import explode_with_position
from pagemill.operators.skew import frequent_keys
from pagemill.sources.robots import WALKED, compile_rules, prefix_rules, short_lists
from pagemill.sources.sitemaps import sitemap_seeds
from pagemill.storage import (
    buckets_once, delete_folder, is_complete, new_folder, read_buckets, same_manifest, write_buckets, write_once,
)

# Page states.
OK, EXTRACT_FAILED, FETCH_FAILED, ROBOTS_BLOCKED = (
    "ok", "extract_failed", "fetch_failed", "robots_blocked",
)
FAILED = (EXTRACT_FAILED, FETCH_FAILED)

VISITED_SCHEMA = (
    "norm string, url string, seed string, depth int, rank array<bigint>, parent string, "
    "page_id bigint, status string"
)
INDEX_SCHEMA = "norm string, page_id bigint, hrefs array<string>, targets array<string>, blank boolean"


@dataclass(frozen=True)
class CrawlRun:
    """Where the levels of a run are and what it visited."""

    folder: str
    visited: DataFrame
    levels: int

    def with_status(self, *status: str) -> DataFrame:
        return self.visited.where(F.col("status").isin(*status))

    def cleanup(self) -> bool:
        """Drop the run state, as after a completed run that need not be resumed."""
        return delete_folder(self.visited.sparkSession, self.folder)


@cache
def _page_facts() -> Column:
    """Links and blank flag of ``(url, html)``; built once per process."""

    def facts(dom: Column) -> Column:
        return F.struct(
            resolve_all(base_url(dom, F.col("url")), dom_hrefs(dom)).alias("hrefs"),
            dom_onclick_targets(dom).alias("targets"),
            is_blank_page(dom).alias("blank"),
        )

    return let(strip_raw(F.coalesce(F.col("html"), F.lit(""))), facts)


def page_index(pages: DataFrame) -> DataFrame:
    """``(norm, page_id, hrefs, targets, blank)``: one slim row per visit key.

    ``hrefs`` are absolute (a browser resolves them against the document), ``targets`` are
    raw onclick addresses (resolved against the visited address later).
    """

    slim = pages.select(
        normalize(F.col("url")).alias("norm"),
        "page_id",
        _page_facts().alias("f"),
        F.col("html").isNull().alias("gone"),
    )
    best = F.min_by(F.struct("page_id", "f", "gone"), F.col("page_id")).alias("best")
    return (
        slim.groupBy("norm").agg(best)
        .select("norm", "best.page_id", "best.f.*", "best.gone")
        .where(~F.col("gone")).drop("gone")
    )


def seed_requests(
    seeds: DataFrame, sitemaps: DataFrame | None = None, max_urls: int | None = None
) -> DataFrame:
    """First frontier: seeds in order, then the sitemap addresses of their sites."""
    first = seeds.select(
        F.col("seed").alias("url"),
        "seed",
        F.array(F.lit(0), F.col("seed_ord"), F.lit(0)).cast("array<bigint>").alias("rank"),
    )
    if sitemaps is not None:
        listed = sitemap_seeds(seeds, sitemaps, max_urls).select(
            F.col("loc").alias("url"),
            "seed",
            F.array(F.lit(1), F.col("seed_ord"), F.col("pos")).cast("array<bigint>").alias("rank"),
        )
        first = first.unionByName(listed)
    return first.select(
        normalize(F.col("url")).alias("norm"), "url", "seed", "rank",
        F.lit(None).cast("string").alias("parent"),
    )


def first_visits(requests: DataFrame) -> DataFrame:
    """The request of least rank per visit key: a minimum, combined before the shuffle."""
    first = F.min(F.struct("rank", "url", "seed", "parent")).alias("first")
    return requests.groupBy("norm").agg(first).select("norm", "first.*")


def _visit(
    frontier: DataFrame, index: DataFrame, rules: DataFrame | None, hot: DataFrame | None, depth: int,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """The level of a frontier: the verdict on slim requests first, then their pages."""
    found = index.select("norm", "page_id", "blank")
    joined = with_verdict(frontier, rules, hot, prefixes).join(found, "norm", "left")
    status = (
        F.when(~F.col("allowed"), ROBOTS_BLOCKED)
        .when(F.col("page_id").isNull(), FETCH_FAILED)
        .when(F.col("blank"), EXTRACT_FAILED)
        .otherwise(OK)
    )
    return joined.select(
        "norm", "url", "seed", F.lit(depth).alias("depth"), "rank", "parent",
        F.when(F.col("allowed"), F.col("page_id")).alias("page_id"), status.alias("status"),
    )


def asked_domains(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """``domain`` of every address that a crawl can ask for: of links, also to hosts without a page, and of seeds.

    A host outside the frequent ones has at most their share of all requests in any level.
    """
    found = F.when(F.size("targets") > 0, F.concat("hrefs", resolve_all(F.col("norm"), F.col("targets")))).otherwise(F.col("hrefs"))
    links = index.select(F.explode(found).alias("url"))
    return links.unionByName(seeds.select("url")).select(domain_key(F.col("url")).alias("domain"))


@cache
def expander(scope: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function from a level and the index to the requests below: links that are pages and in scope.

    The expressions are built once and serve every level.
    """
    found = F.when(
        F.size("targets") > 0, F.concat("hrefs", resolve_all(F.col("url"), F.col("targets")))
    ).otherwise(F.col("hrefs"))
    follow = ~is_junk(F.col("target")) & in_scope(F.col("target"), F.col("seed"), scope)
    norm = normalize(F.col("target")).alias("norm")

    def expand(level: DataFrame, index: DataFrame) -> DataFrame:
        followed = level.where(F.col("status").isin(OK, EXTRACT_FAILED)).select("norm", "url", "seed", "rank")
        exploded = explode_with_position(
            followed.join(index.select("norm", "hrefs", "targets"), "norm"),
            [F.col("url").alias("parent"), "seed", "rank"], found, "pos", "target",
        )
        return exploded.where(follow).select(
            norm, F.col("target").alias("url"), "seed",
            F.array_append("rank", F.col("pos").cast("bigint")).alias("rank"), "parent",
        )

    return expand


def _level_path(folder: str, depth: int) -> str:
    return f"{folder}/levels/level-{depth:04d}"


def load_run(spark: SparkSession, folder: str) -> CrawlRun:
    """State of an earlier run; a missing folder is a run that visited nothing."""
    depth = 0
    while is_complete(spark, _level_path(folder, depth)):
        depth += 1
    if depth == 0:
        return CrawlRun(folder, spark.createDataFrame([], VISITED_SCHEMA), 0)
    return CrawlRun(folder, _visited(spark, folder, depth), depth)


def _visited(spark: SparkSession, folder: str, levels: int) -> DataFrame:
    return spark.read.schema(VISITED_SCHEMA).parquet(*[_level_path(folder, d) for d in range(levels)])


def store_index(pages: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """``page_index(pages)`` as a bucketed table, for crawls to share."""
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return buckets_once(spark, path, INDEX_SCHEMA, "norm", buckets, lambda: page_index(pages))


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    *,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    agent: str = "pagemill",
    scope: str = "same_domain",
    max_depth: int = 0,
    max_pages: int | None = None,
    sitemap_max_urls: int | None = None,
    visited: DataFrame | None = None,
    retry_failed: bool = False,
    index: DataFrame | None = None,
    folder: str | None = None,
    progress: Callable[[int, int], None] | None = None,
) -> CrawlRun:
    """Visit ``pages`` from ``seeds`` to ``max_depth`` levels of links.

    ``visited`` (of an earlier run) is never visited again; with ``retry_failed`` its failed
    pages are.  ``index`` takes what ``store_index`` returned so that runs can share one.  Called
    again with the ``folder`` of an earlier run it goes on after the last complete level, also
    to a greater depth; seeds, robots documents, sitemaps or options that differ from that run's
    are an error.  ``progress`` is told each depth and its page count.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "crawl")
    inputs = {"seeds": seeds, "robots": robots, "sitemaps": sitemaps}
    if visited is not None:
        inputs["visited"] = visited.select("norm", "status")
    stored = same_manifest(spark, f"{folder}/options", {
        "scope": scope, "agent": agent, "max_pages": max_pages, "sitemap_max_urls": sitemap_max_urls,
        "retry_failed": retry_failed, "_buckets": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }, {name: df for name, df in inputs.items() if df is not None}, "crawl")
    buckets = int(stored["_buckets"])

    @cache
    def pages_index() -> DataFrame:
        return store_index(pages, f"{folder}/index", buckets) if index is None else index

    @cache
    def host_rules() -> tuple[DataFrame | None, ...]:
        """Rules by host, hosts that many requests ask for, and rules by prefix where lists are long."""
        if robots is None:
            return None, None, None
        rules = write_once(spark, f"{folder}/rules", lambda: compile_rules(robots, agent))
        hot = write_once(
            spark, f"{folder}/hot-domains",
            lambda: frequent_keys(asked_domains(pages_index(), seed_requests(seeds, sitemaps, sitemap_max_urls)), "domain"),
        )
        if rules.where(F.size("rules") > WALKED).isEmpty():
            return rules, hot, None
        prefixes = write_once(spark, f"{folder}/rules-by-prefix", lambda: prefix_rules(rules))
        return short_lists(rules), hot, prefixes

    if visited is not None:
        done = visited.where(~F.col("status").isin(*FAILED)) if retry_failed else visited
        buckets_once(spark, f"{folder}/levels/earlier", "norm string", "norm", buckets, lambda: done.select("norm").distinct())

    expand = expander(scope)
    budget = max_pages
    depth = 0

    def visit_level() -> DataFrame:
        if depth == 0:
            requests = seed_requests(seeds, sitemaps, sitemap_max_urls)
        else:
            requests = expand(level, pages_index())
        frontier = first_visits(requests)
        if depth > 0 or visited is not None:
            seen = read_buckets(spark, f"{folder}/levels", "norm string", "norm", buckets, recursive=True)
            frontier = frontier.join(seen, "norm", "left_anti")
        if budget is not None:
            frontier = first_n(frontier, budget, F.col("rank"), F.col("norm"))
        rules, hot, prefixes = host_rules()
        return _visit(frontier, pages_index(), rules, hot, depth, prefixes)

    while True:
        path = _level_path(folder, depth)
        if not is_complete(spark, path):
            delete_folder(spark, path)  # what a broken-off attempt left is no visit
            write_buckets(visit_level(), path, "norm", buckets)
        level = read_buckets(spark, path, VISITED_SCHEMA, "norm", buckets)
        depth += 1
        last = depth > max_depth
        size = 0 if last and progress is None else level.count()
        if progress is not None:
            progress(depth - 1, size)
        if last:
            break
        if budget is not None:
            budget -= size
        if size == 0 or budget == 0:
            break
    return CrawlRun(folder, _visited(spark, folder, depth), depth)


def frontier_sizes(run: CrawlRun) -> DataFrame:
    return run.visited.groupBy("depth").agg(F.count(F.lit(1)).alias("pages"))


def failed(run: CrawlRun) -> DataFrame:
    """``(url, reason, depth)`` of pages that were not fetched or not extracted."""
    return run.with_status(*FAILED).select("url", F.col("status").alias("reason"), "depth", "rank")
