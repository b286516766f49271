"""Sitemap documents: ``(base_url, xml)`` rows to page addresses.

``urlset`` lists pages, ``sitemapindex`` lists further sitemaps; both give their ``<loc>``
values and index entries are not followed.  Broken XML gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import domain_key, resolve
from pagemill.operators.rows import explode_with_position

# Fixed value: a usual cap on the addresses of one sitemap, for callers that want one.
USUAL_CAP = 500

_DOC_TYPE = (
    "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _broken string"
)
_ROOT_RE = (
    r"(?is)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!doctype[^>]*>\s*)*<(?:[\w.\-]+:)?"
    r"([\w.\-]*?(?:urlset|sitemapindex)[\w.\-]*)"
)
_ANY_LOC = "//*[local-name() = 'url' or local-name() = 'sitemap']/*[local-name() = 'loc']/text()"


def sitemap_address(base_url: Column) -> Column:
    return resolve(base_url, F.lit("/sitemap.xml"))


def parse_sitemaps(docs: DataFrame, max_urls: int | None = None, xml: str = "xml") -> DataFrame:
    """Input columns plus ``kind`` (``page`` or ``sitemap``), ``pos`` and ``loc``.

    ``max_urls`` cuts each document's own list (a slice: no window, no shuffle); by default
    every address is listed.
    """
    root = F.lower(F.regexp_extract(F.col(xml), _ROOT_RE, 1))
    is_urlset = F.contains(root, F.lit("urlset"))
    parsed = docs.withColumn("_root", root).withColumn(
        "_doc",
        F.when(
            F.col("_root") != "",
            F.from_xml(
                F.col(xml), _DOC_TYPE,
                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"},
            ),
        ),
    )
    listed = F.when(is_urlset, F.col("_doc.url.loc")).otherwise(F.col("_doc.sitemap.loc"))
    listed = F.filter(listed, lambda v: v != "")
    # prefixed namespaces escape from_xml; xpath runs on well-formed documents only
    located = (
        F.when(F.col("_doc._broken").isNotNull() | F.col("_doc").isNull(), F.lit(None))
        .when(F.size(listed) > 0, listed)
        .otherwise(F.xpath(F.col(xml), F.lit(_ANY_LOC)))
    )
    listed = F.transform(located, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    if max_urls is not None:
        listed = F.slice(listed, 1, max_urls)
    kind = F.when(F.contains(F.col("_root"), F.lit("urlset")), F.lit("page")).otherwise(F.lit("sitemap"))
    carried = [F.col(c) for c in docs.columns if c != xml]
    return explode_with_position(parsed, [*carried, kind.alias("kind")], listed, "pos", "loc")


def sitemap_seeds(
    seeds: DataFrame, docs: DataFrame, max_urls: int | None = None
) -> DataFrame:
    """``(seed_ord, seed, pos, loc)``: sitemap addresses credited to the first seed of a site.

    A later seed of the same site would add the same addresses again, and the first visit
    wins; so seeds are cut to one per site before the join instead of pairing all of them.
    """
    first = (
        seeds.withColumn("site", domain_key(F.col("seed")))
        .groupBy("site")
        .agg(F.min(F.struct("seed_ord", "seed")).alias("first"))
        .select("site", "first.*")
    )
    of_site = docs.select(domain_key(F.col("base_url")).alias("site"), "xml")
    listed = parse_sitemaps(first.join(of_site, "site"), max_urls)
    return listed.select("seed_ord", "seed", "pos", "loc")
