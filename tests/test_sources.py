"""Seeds, pages, sitemaps and cache."""

import re

from pyspark.sql import functions as F

from pagemill.functions.urls import url_key
from pagemill.sources import cache, pages, seeds, sitemaps

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_seed_file(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\nhttps://b/ \n  https://a/\n  # note\nhttps://c/#x\n")
    rows = seeds.read_seeds(spark, str(tmp_path / "urls.txt")).orderBy("seed_ord").collect()
    assert [r["seed"] for r in rows] == ["https://b/", "https://a/", "https://c/#x"]


def test_seed_list_wins_over_start_url(spark):
    assert [r["seed"] for r in seeds.seeds(spark, ["u", "v"], "w").orderBy("seed_ord").collect()] == ["u", "v"]
    assert [r["seed"] for r in seeds.seeds(spark, None, "w").collect()] == ["w"]
    assert seeds.seeds(spark).count() == 0


def test_render_takes_the_first_page_and_keeps_misses(spark):
    table = spark.createDataFrame(
        [(2, "http://h/a/", "late"), (1, "http://h/a#x", "early"), (3, "http://h/b", None)], pages.PAGE_SCHEMA
    )
    asked = spark.createDataFrame([("http://h/a",), ("http://h/a/",), ("http://h/b",), ("http://h/c",)], "url string")
    got = {r["url"]: r["html"] for r in pages.render(asked, table).collect()}
    assert got == {"http://h/a": "early", "http://h/a/": "early", "http://h/b": None, "http://h/c": None}


SITEMAPS = {
    "default namespace": (f"<urlset {NS}><url><loc> http://h/1?a=1&amp;b=2 </loc></url><url><loc>http://h/2</loc></url></urlset>",
                          [("page", "http://h/1?a=1&b=2"), ("page", "http://h/2")]),
    "bare": ("<urlset><url><loc>u</loc></url></urlset>", [("page", "u")]),
    "prefixed": ('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>u</s:loc></s:url></s:urlset>',
                 [("page", "u")]),
    "index": (f"<?xml version='1.0'?><!-- i --><sitemapindex {NS}><sitemap><loc>s.xml</loc></sitemap></sitemapindex>",
              [("sitemap", "s.xml")]),
    "blank loc": ("<urlset><url><loc></loc></url><url><loc>u</loc></url></urlset>", [("page", "u")]),
    "with image": (f'<urlset {NS} xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"><url><loc>u</loc>'
                   "<image:image><image:loc>i.png</image:loc></image:image></url></urlset>", [("page", "u")]),
    "other root": ("<rss><url><loc>u</loc></url></rss>", []),
    "broken": ("<urlset><url><loc>u</loc></url>", []),
    "not xml": ("404 not found", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_sitemaps(spark):
    docs = spark.createDataFrame([(k, x) for k, (x, _) in SITEMAPS.items()], "name string, xml string")
    rows = sitemaps.parse_sitemaps(docs).orderBy("name", "pos").collect()
    got = {k: [(r["kind"], r["loc"]) for r in rows if r["name"] == k] for k in SITEMAPS}
    assert got == {k: wanted for k, (_, wanted) in SITEMAPS.items()}


def test_sitemap_cap_is_per_document(spark):
    xml = "<urlset>" + "".join(f"<url><loc>http://h/{i}</loc></url>" for i in range(600)) + "</urlset>"
    docs = spark.createDataFrame([("a", xml), ("b", xml)], "name string, xml string")
    assert {r["count"] for r in sitemaps.parse_sitemaps(docs, sitemaps.USUAL_CAP).groupBy("name").count().collect()} == {500}
    assert {r["count"] for r in sitemaps.parse_sitemaps(docs).groupBy("name").count().collect()} == {600}


def test_prefixed_sitemap_lists_pages_only(spark):
    xml = """<sm:urlset xmlns:sm="s" xmlns:image="i"><sm:url><sm:loc>http://a/1</sm:loc>
        <image:image><image:loc>http://a/1.png</image:loc></image:image></sm:url></sm:urlset>"""
    docs = spark.createDataFrame([(xml,)], "xml string")
    assert [r["loc"] for r in sitemaps.parse_sitemaps(docs).collect()] == ["http://a/1"]


def test_sitemap_rows_go_to_the_first_seed_of_a_site(spark):
    docs = spark.createDataFrame([("http://h", "<urlset><url><loc>http://h/s</loc></url></urlset>")], "base_url string, xml string")
    s = spark.createDataFrame([(0, "http://other/"), (1, "http://h/x"), (2, "http://h/y")], seeds.SEED_SCHEMA)
    assert [tuple(r) for r in sitemaps.sitemap_seeds(s, docs).collect()] == [(1, "http://h/x", 0, "http://h/s")]


def test_cache_keeps_first_and_grows(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("u", "one"), ("v", "")], "url string, markdown string")
    assert cache.read_cache(spark, path).count() == 0
    cache.write_cache(cache.cache_rows(first), path)
    again = spark.createDataFrame([("u", "two"), ("w", "three"), ("w", "three")], "url string, markdown string")
    cache.write_cache(cache.cache_rows(again), path)
    stored = cache.read_cache(spark, path)
    assert {r["url"]: r["markdown"] for r in stored.collect()} == {"u": "one", "w": "three"}
    assert cache.cache_size(stored).first()[0] == 2
    asked = spark.createDataFrame([("u",), ("v",), ("x",)], "url string")
    hits = {r["url"]: r["hit"] for r in cache.look_up(asked, stored).collect()}
    assert hits == {"u": True, "v": False, "x": False}


def test_cache_key_by_norm(spark):
    rows = spark.createDataFrame([("http://h/a/", "m")], "url string, markdown string")
    stored = cache.cache_rows(rows, use_norm=True)
    asked = spark.createDataFrame([("http://h/a#x",)], "url string")
    assert cache.look_up(asked, stored, use_norm=True).where(F.col("hit")).count() == 1


def test_a_lookup_reads_only_the_partitions_it_asks_for(spark, tmp_path):
    path = str(tmp_path / "cache")
    pages = spark.range(400).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("t"), "id").alias("markdown"))
    cache.put(cache.cache_rows(pages), path, "a")
    asked = pages.where("url in ('http://h/7', 'http://h/8')").select("url")
    narrow = cache.read_cache(spark, path, asked)
    keys = {r["k"] for r in asked.select(url_key(F.col("url")).alias("k")).collect()}
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", narrow._jdf.queryExecution().toString())[1]
    asked_for = set(re.findall(r"\b[0-9a-f]{2}\b", re.sub(r"#\d+", "", filters)))
    assert asked_for == {k[:2] for k in keys} and len(asked_for) == 2
    found = cache.look_up(asked, narrow).collect()
    assert {(r["url"], r["cached"], r["hit"]) for r in found} == {("http://h/7", "t7", True), ("http://h/8", "t8", True)}


def test_the_row_stored_last_counts_and_repeats_add_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([(f"http://h/{i}", "old") for i in range(30)], "url string, markdown string")
    new = spark.createDataFrame([(f"http://h/{i}", "new") for i in range(10)], "url string, markdown string")
    for _ in range(2):
        cache.put(cache.cache_rows(old), path, "first")
    cache.put(cache.cache_rows(new), path, "second")
    for _ in range(2):
        cache.put(cache.cache_rows(new), path, "third")
    assert cache.read_cache(spark, path).count() == 50
    asked = old.select("url")

    def texts():
        return {r["url"]: r["cached"] for r in cache.look_up(asked, cache.read_cache(spark, path, asked)).collect()}

    want = {f"http://h/{i}": "new" if i < 10 else "old" for i in range(30)}
    assert texts() == want
    cache.compact(spark, path)
    assert texts() == want and cache.read_cache(spark, path).count() == 30
    cache.compact(spark, path)
    assert cache.read_cache(spark, path).count() == 30
