"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import domain_key, netloc
from pagemill.sources.pages import balanced, distinct_pages, with_norm

AGENT = "pagemill"
SHAPES = 12

# One text for a third of the domains each; the last third has no robots file.
ROBOTS_OPEN = (
    "# all agents\n"
    "User-agent: *\n"
    "Allow: /en/1\n"
    "Disallow: /en/\n"
    "Disallow: /The\n"
)
ROBOTS_NAMED = (
    "User-agent: *\n"
    "Disallow: /\n"
    "\n"
    "User-agent: otherbot\n"
    "User-agent: PageMill\n"
    "Crawl-delay: 5\n"
    "Disallow: /de/ # trailing comment\n"
    "Allow: /\n"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` for queries that parse html."""
    return balanced(pages(spark, sf_dir))


def page_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address is a seed, in page order."""
    return pages(spark, sf_dir).select(F.col("page_id").alias("seed_ord"), F.col("url").alias("seed"))


def host_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host."""
    first = F.min(F.struct("page_id", "url")).alias("f")
    by_host = pages(spark, sf_dir).select("page_id", "url", netloc(F.col("url")).alias("host"))
    return by_host.groupBy("host").agg(first).select(
        F.col("f.page_id").alias("seed_ord"), F.col("f.url").alias("seed")
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that also link to the pages ``2n+1``, ``2n+2`` and ``n/2``: a tree with cycles."""
    p = html_pages(spark, sf_dir)
    address = pages(spark, sf_dir).select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url"))
    n = F.col("page_id")
    wanted = pages(spark, sf_dir).select(
        "page_id",
        F.posexplode(F.array(2 * n + 1, 2 * n + 2, F.floor(n / 2).cast("bigint"))).alias("k", "to_id"),
    )
    anchor = F.concat(F.lit('<a href="'), F.replace("to_url", F.lit("&"), F.lit("&amp;")), F.lit('">n</a>'))
    # at most three anchors per page by construction
    anchors = wanted.join(address, "to_id").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", anchor.alias("a")))),
                                 lambda e: e["a"]), "").alias("anchors")
    )
    return p.join(anchors, "page_id", "left").select(
        "page_id", "url", F.concat("html", F.coalesce("anchors", F.lit(""))).alias("html")
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(domain_key(F.col("url")).alias("domain")).distinct()


def robots_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.length("domain") % 3
    return (
        domains(spark, sf_dir).where(third != 0)
        .select("domain", F.when(third == 1, ROBOTS_OPEN).otherwise(ROBOTS_NAMED).alias("text"))
    )


def long_robots_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,001 rules for all hosts but a third, whose list is short: prefixes of several lengths, some of them twice."""
    rule = F.transform(
        F.sequence(F.lit(0), F.lit(1999)),
        lambda i: F.concat(F.when(i % 3 == 0, F.lit("Allow: /en/")).otherwise(F.lit("Disallow: /en/")), (i * 7 % 1500).cast("string")),
    )
    long = F.concat(F.lit("User-agent: *\n"), F.concat_ws("\n", rule), F.lit("\nDisallow: /en/1\n"))
    return domains(spark, sf_dir).select(
        "domain", F.when(F.length("domain") % 3 == 0, F.lit(ROBOTS_OPEN)).otherwise(long).alias("text")
    )


def _loc(address: Column) -> Column:
    return F.concat(F.lit("<loc> "), F.replace(address, F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"))


def page_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per page: urlset, bare urlset, prefixed urlset, index or broken XML."""
    url = F.col("url")
    locs = [url, F.concat(url, F.lit("&a=1")), F.concat(url, F.lit("/z"))]
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"

    def doc(head: str, entry: str, tail: str, prefix: str = "") -> Column:
        parts: list[Column] = [F.lit(head)]
        for loc in locs:
            body = _loc(loc)
            if prefix:
                body = F.replace(F.replace(body, F.lit("<loc>"), F.lit(f"<{prefix}loc>")),
                                 F.lit("</loc>"), F.lit(f"</{prefix}loc>"))
            parts += [F.lit(f"<{prefix}{entry}>"), body, F.lit(f"</{prefix}{entry}>")]
        return F.concat(*parts, F.lit(tail))

    kind = F.col("page_id") % 5
    declared = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- pages -->\n'
    xml = (
        F.when(kind == 0, doc(f'{declared}<urlset xmlns="{ns}">', "url", "</urlset>"))
        .when(kind == 1, doc("<urlset>", "url", "</urlset>"))
        .when(kind == 2, doc(f'<sm:urlset xmlns:sm="{ns}">', "url", "</sm:urlset>", "sm:"))
        .when(kind == 3, doc(f'<sitemapindex xmlns="{ns}">', "sitemap", "</sitemapindex>"))
        .otherwise(doc("<urlset>", "url", "</urlset"))
    )
    return pages(spark, sf_dir).select("page_id", "url", xml.alias("xml"))


def site_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("domain")
    xml = F.concat(
        F.lit("<urlset><url>"), _loc(F.concat(d, F.lit("/s/1"))), F.lit("</url><url>"),
        _loc(F.concat(d, F.lit("/s/2/#x"))), F.lit("</url></urlset>"),
    )
    return domains(spark, sf_dir).select(d.alias("base_url"), xml.alias("xml"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results in twelve shapes, one per line item; see ``oracles.SHAPE_ROWS``."""
    li = balanced(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_returnflag", "l_linestatus",
    ))
    part, supp, price = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")
    quantity = F.col("l_quantity").cast("bigint").cast("string")

    def obj(**fields: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    shapes = [
        F.to_json(obj(items=F.array(obj(part=part, price=price), obj(part=supp, price=F.col("l_quantity"))))),
        F.to_json(F.array(obj(part=part, price=price))),
        F.to_json(obj(a=F.array(part), b=F.array(supp))),
        F.to_json(obj(order=obj(key=F.col("l_orderkey"), flag=F.col("l_returnflag")), total=price)),
        F.to_json(F.array(part, supp)),
        F.lit('{"l":[]}'),
        F.lit("{}"),
        text('"', F.col("l_linestatus"), ' [1]"'),
        text(quantity, ".5"),
        text('{"broken":', part),
        text('{"part":', part, ',"_source_url":"payload"}'),
        text('[{"part":', part, '},"x",null]'),
    ]
    shape = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % SHAPES
    data = F.lit(None).cast("string")
    for number, column in enumerate(shapes):
        data = F.when(shape == number, column).otherwise(data)
    return li.select(
        "l_orderkey", "l_linenumber",
        text("https://shop.example/", F.col("l_orderkey"), "/", F.col("l_linenumber")).alias("source_url"),
        (F.col("l_linenumber") % 3).alias("depth"),
        data.alias("data"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visit log with states by page number."""
    k = F.col("page_id") % 10
    status = (
        F.when(k == 0, "robots_blocked").when(k == 1, "fetch_failed").when(k == 2, "extract_failed")
        .otherwise("ok")
    )
    return pages(spark, sf_dir).select("page_id", "url", status.alias("status"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with numbers, text with quotes and pipes, nulls, a list and a dotted column."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"),
        F.concat(F.col("o_orderpriority"), F.lit(', "é" | '), F.col("o_orderstatus")).alias("note"),
        F.array(F.col("o_custkey"), F.col("o_orderkey")).alias("tags"),
        F.col("o_orderstatus").alias("order.status"),
    )


def distinct_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pages(pages(spark, sf_dir)).select("norm")


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_norm(pages(spark, sf_dir))
