"""Robots rules against the standard library's parser."""

from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions.robots import is_allowed, rules_for_agent
from pagemill.operators.robots import with_verdict
from pagemill.operators.crawl import asked_domains, page_index, seed_requests
from pagemill.operators.skew import frequent_keys, hot_keys, salted_left_join
from pagemill.sources.robots import compile_rules, prefix_rules, rule_rows, short_lists

AGENT = "PageMill/1.0"
TEXTS = [
    "",
    "User-agent: *\nDisallow: /",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nAllow: /a/ok\nDisallow: /a\n",
    "User-agent: *\nDisallow: /a\nAllow: /a/ok\n",
    "User-agent: *\nDisallow: /\n\nUser-agent: pagemill\nDisallow: /private\n",
    "User-agent: pagemill\nDisallow: /private\nUser-agent: *\nDisallow: /\n",
    "User-agent: other\nUser-agent: PAGE\nDisallow: /x # why\n# whole line\nAllow: /\n",
    "User-agent: *\n\nDisallow: /\n",
    "Disallow: /\nUser-agent: *\nDisallow: /x\n",
    "User-agent: *\nCrawl-delay: 3\nUser-agent: pagemill\nDisallow: /\n",
    "User-agent: *\r\nDisallow: /caf%C3%A9\r\nDisallow: /sp ace\r\nDisallow: /q?x=1\r\n",
    "User-agent: *\nDisallow: /*.html\nSitemap: http://h/s.xml\nDisallow: /z\n",
    "user-AGENT : *\n  disallow : /x  \nnonsense\n \nDisallow: /y\n",
    "User-agent:\nDisallow: /empty-agent\n",
    "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n",
    "User-agent: pagemill\nUser-agent: *\nDisallow: /both\n",
    "User-agent: *\nDisallow: /a?\nDisallow: /b#\nDisallow: /%zz\nDisallow: /plus+x\n",
]
URLS = [
    "http://h", "http://h/", "http://h/a", "http://h/a/ok", "http://h/b", "http://h/private/x", "http://h/x",
    "http://h/y", "http://h/z", "http://h/café", "http://h/caf%C3%A9", "http://h/sp%20ace", "http://h/sp ace",
    "http://h/q?x=1&y=2", "http://h/p.html", "http://h/*.html", "http://h/empty-agent", "http://h/both",
    "http://h/%zz", "http://h/plus+x", "http://h/plus%2Bx", "http://h/a?x#y", "http://h/~u",
]


def stdlib(text, url):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser.can_fetch(AGENT, url)


def test_verdict_equals_stdlib(apply):
    rows = [(t, u) for t in TEXTS for u in URLS]
    got = apply(lambda t, u: is_allowed(u, rules_for_agent(t, AGENT)), rows)
    wrong = [(r, g) for r, g in zip(rows, got) if g != stdlib(*r)]
    assert wrong == []


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(
        [("http://h", TEXTS[3]), ("https://h", TEXTS[1]), ("http://k", "")], "domain string, text string"
    )


def test_rules_keep_file_order(docs):
    rows = rule_rows(docs, AGENT).orderBy("domain", "rule_no").collect()
    assert [tuple(r) for r in rows] == [
        ("http://h", 0, True, "/a/ok"), ("http://h", 1, False, "/a"), ("https://h", 0, False, "/"),
    ]


def test_verdict_per_domain_and_off_switch(spark, docs):
    asked = spark.createDataFrame(
        [("http://h/a",), ("http://h/a/ok",), ("https://h/a",), ("http://k/a",), ("http://none/a",)], "url string"
    )
    got = dict(with_verdict(asked, compile_rules(docs, AGENT)).select("url", "allowed").collect())
    assert got == {
        "http://h/a": False, "http://h/a/ok": True, "https://h/a": False, "http://k/a": True, "http://none/a": True,
    }
    assert with_verdict(asked, None).where("allowed").count() == 5


def test_hot_key_is_spread_and_nothing_is_lost(spark):
    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "key string, v int")
    hot = hot_keys(big, "key", 1)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    joined = salted_left_join(big, lookup, "key", F.col("id"), hot, salts=8)
    plain = big.join(lookup, "key", "left")
    assert joined.exceptAll(plain.select(joined.columns)).count() == 0
    assert joined.count() == 9000


def test_frequent_keys_misses_none(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "warm")
        .when(F.col("id") % 50 == 2, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    )
    assert {r["key"] for r in frequent_keys(rows, "key").collect()} == {"hot", "warm"}
    assert {r["key"] for r in frequent_keys(rows, "key", share=10).collect()} == {"hot"}
    assert frequent_keys(rows.limit(0), "key").count() == 0


def test_links_to_a_host_without_pages_are_spread(spark):
    """The most asked host is outside of the page table: it is known from the links alone."""
    html = "".join(f"<a href='http://out/{i}'>x</a>" for i in range(50))
    pages = spark.createDataFrame([(i, f"http://h{i}/", html) for i in range(8)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(i, f"http://h{i}/") for i in range(8)], "seed_ord long, seed string")
    asked = asked_domains(page_index(pages), seed_requests(seeds, None, None))
    assert asked.count() == 8 * 50 + 8
    hot = frequent_keys(asked, "domain")
    assert "http://out" in {r["domain"] for r in hot.collect()}
    rules = compile_rules(spark.createDataFrame([("http://out", TEXTS[1])], "domain string, text string"), AGENT)
    left = asked.withColumn("n", F.monotonically_increasing_id())
    joined = salted_left_join(left, rules, "domain", F.col("n"), hot)
    assert joined.count() == left.count()
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("_salt") >= 2


@pytest.mark.parametrize("walked", [0, 2, 64])
def test_prefix_lookup_equals_walking(spark, walked):
    many = "User-agent: *\n" + "\n".join(
        f"{'Allow' if i % 4 else 'Disallow'}: /{'p' * (i % 7)}{i * 37 % 9000}" for i in range(10000)
    ) + "\nDisallow: /p\nAllow:\nDisallow: /\n"
    texts = [*TEXTS, many]
    docs = spark.createDataFrame([(f"http://h{i}", t) for i, t in enumerate(texts)], "domain string, text string")
    tails = [u.removeprefix("http://h") for u in URLS] + [f"/{'p' * (i % 7)}{i * 7}" for i in range(40)]
    urls = [(f"http://h{i}{t}", i) for i in range(len(texts) + 1) for t in tails] + [(None, 0), (f"http://h{len(TEXTS)}/p1", 9)] * 2
    asked = spark.createDataFrame(urls, "url string, lengths int")
    rules = compile_rules(docs, AGENT)
    walk = with_verdict(asked, rules)
    found = with_verdict(asked, short_lists(rules, walked), prefixes=prefix_rules(rules, walked))
    assert found.columns == walk.columns and found.count() == len(urls)
    assert found.exceptAll(walk).count() == 0 and walk.where("not allowed").count() > 50
