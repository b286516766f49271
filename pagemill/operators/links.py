"""Page links as rows, and the filters that decide which of them to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.links import hrefs, onclick_targets, page_links_of
from pagemill.functions.urls import SCOPES, in_scope, is_junk, normalize
from pagemill.operators.rows import explode_with_position


def raw_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, link)`` of every ``a[href]``, unresolved, in document order."""
    return explode_with_position(pages, ["page_id", "url"], hrefs(F.col("html")), "pos", "link")


def onclick_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, link)`` of the addresses named in onclick handlers."""
    return explode_with_position(
        pages, ["page_id", "url"], onclick_targets(F.col("html")), "pos", "link"
    )


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, target)``: anchors, then onclick targets, all absolute."""
    return explode_with_position(
        pages, ["page_id", "url"], page_links_of(), "pos", "target"
    )


def followable(
    candidates: DataFrame,
    scope: str = "same_domain",
    max_depth: int | None = None,
    visited: DataFrame | None = None,
) -> DataFrame:
    """Candidates ``(target, depth, seed, …)`` that are pages, in scope, in depth and new."""
    if scope not in SCOPES:
        raise ValueError(f"{scope!r} is no scope; there are {', '.join(SCOPES)}")
    kept = candidates.where(~is_junk(F.col("target")))
    if max_depth is not None:
        kept = kept.where(F.col("depth") <= max_depth)
    kept = kept.where(in_scope(F.col("target"), F.col("seed"), scope))
    if visited is not None:
        kept = unvisited(kept.withColumn("norm", normalize(F.col("target"))), visited)
    return kept


def unvisited(requests: DataFrame, visited: DataFrame) -> DataFrame:
    return requests.join(visited.select("norm"), "norm", "left_anti")


def links_per_page(candidates: DataFrame, scope: str = "same_domain") -> DataFrame:
    """``(url, links, followed)`` per page, counted with map-side combine."""
    follow = ~is_junk(F.col("target")) & in_scope(F.col("target"), F.col("seed"), scope)
    return candidates.groupBy("url").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(follow).alias("followed")
    )
