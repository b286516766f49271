"""The crawl against a queue simulated in plain Python."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl as c
from pagemill.operators.limits import first_n
from pagemill.sources.pages import PAGE_SCHEMA
from pagemill.sources.seeds import SEED_SCHEMA
from pagemill.storage import delete_folder, read_buckets

GRAPH = {
    "http://h/": ["a", "b", "#top", "http://k/", "x.pdf", "mailto:m@h"],
    "http://h/a": ["b", "c", "/a/"],
    "http://h/b": ["d", "/"],
    "http://h/c": ["d", "e"],
    "http://h/d": ["f"],
    "http://h/e": None,
    "http://k/": ["http://h/e", "z"],
    "http://k/z": ["http://h/f"],
}


def page_table(spark):
    rows = []
    for i, (url, found) in enumerate(GRAPH.items()):
        html = "" if found is None else "<p>t</p>" + "".join(f'<a href="{l}">x</a>' for l in found)
        rows.append((i, url, html))
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def seed_table(spark, *urls):
    return spark.createDataFrame(list(enumerate(urls)), SEED_SCHEMA)


def queue_crawl(seeds, scope, max_depth, blocked=(), cap=None):
    """First in, first out; the order every tie is settled by."""
    from urllib.parse import urljoin, urlparse

    norm = lambda u: u.split("#")[0].rstrip("/")
    content = {norm(u): l for u, l in GRAPH.items()}
    queue = deque((u, 0, u, None) for u in seeds)
    seen, out = set(), []
    while queue and (cap is None or len(out) < cap):
        url, depth, seed, parent = queue.popleft()
        if norm(url) in seen:
            continue
        seen.add(norm(url))
        if any(urlparse(url).path.startswith(b) for b in blocked):
            out.append((url, depth, seed, parent, "robots_blocked"))
            continue
        if norm(url) not in content:
            out.append((url, depth, seed, parent, "fetch_failed"))
            continue
        found = content[norm(url)]
        out.append((url, depth, seed, parent, "ok" if found is not None else "extract_failed"))
        for link in (found or []) if depth < max_depth else []:
            target = urljoin(url, link)
            if not target.startswith("http") or target.endswith(".pdf"):
                continue
            if scope == "same_domain" and urlparse(target).netloc != urlparse(seed).netloc:
                continue
            queue.append((target, depth + 1, seed, url))
    return sorted(out)


def visits(run):
    return sorted(tuple(r) for r in run.visited.select("url", "depth", "seed", "parent", "status").collect())


@pytest.mark.parametrize(
    "seeds, scope, depth",
    [(["http://h/"], "same_domain", 0), (["http://h/"], "same_domain", 4), (["http://h/"], "external", 2),
     (["http://k/", "http://h/"], "external", 3), (["http://h/b", "http://h/a", "http://h/a/"], "same_domain", 2)],
)
def test_equals_queue(spark, seeds, scope, depth):
    run = c.crawl(page_table(spark), seed_table(spark, *seeds), scope=scope, max_depth=depth)
    assert visits(run) == queue_crawl(seeds, scope, depth)


@pytest.mark.parametrize("cap", [1, 3, 5])
def test_cap_equals_queue(spark, cap):
    run = c.crawl(page_table(spark), seed_table(spark, "http://h/"), scope="external", max_depth=3, max_pages=cap)
    assert visits(run) == queue_crawl(["http://h/"], "external", 3, cap=cap)


def test_robots_block_and_stop_links(spark):
    robots = spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /a\n")], "domain string, text string")
    run = c.crawl(page_table(spark), seed_table(spark, "http://h/"), robots=robots, max_depth=3)
    assert visits(run) == queue_crawl(["http://h/"], "same_domain", 3, blocked=("/a",))
    assert run.with_status(c.ROBOTS_BLOCKED).count() == 1


def test_blank_page_fails_but_its_links_are_followed(spark):
    table = spark.createDataFrame(
        [(0, "http://h/", "<a href='/x'></a><script>1</script>"), (1, "http://h/x", "<p>x</p>"),
         (2, "http://h/y", "<p></p><div onclick=\"go('/x')\"></div>")], PAGE_SCHEMA,
    )
    run = c.crawl(table, seed_table(spark, "http://h/y"), max_depth=1)
    assert visits(run) == [
        ("http://h/x", 1, "http://h/y", "http://h/y", "ok"),
        ("http://h/y", 0, "http://h/y", None, "extract_failed"),
    ]


def test_resume_skips_what_was_visited_and_can_retry_failures(spark):
    table = page_table(spark)
    first = c.crawl(table, seed_table(spark, "http://h/", "http://gone/"), max_depth=1)
    again = c.load_run(spark, first.folder)
    assert visits(again) == visits(first)
    rest = c.crawl(table, seed_table(spark, "http://h/", "http://gone/", "http://h/d"), max_depth=0, visited=again.visited)
    assert [v[0] for v in visits(rest)] == ["http://h/d"]
    retried = c.crawl(
        table, seed_table(spark, "http://h/", "http://gone/"), max_depth=0, visited=again.visited, retry_failed=True
    )
    assert [v[0] for v in visits(retried)] == ["http://gone/"]


def test_missing_run_is_a_fresh_start_and_cleanup_removes_it(spark, tmp_path):
    assert c.load_run(spark, str(tmp_path / "none")).visited.count() == 0
    run = c.crawl(page_table(spark), seed_table(spark, "http://h/"))
    assert c.load_run(spark, run.folder).levels == 1
    assert run.cleanup()
    assert c.load_run(spark, run.folder).levels == 0


def test_broken_off_run_goes_on_after_its_last_level(spark):
    table, seeds = page_table(spark), seed_table(spark, "http://h/", "http://k/")
    steps = []
    whole = c.crawl(table, seeds, scope="external", max_depth=3, progress=lambda d, n: steps.append((d, n)))
    wanted = visits(whole)
    sizes = c.frontier_sizes(whole).orderBy("depth").collect()
    assert steps == [(r["depth"], r["pages"]) for r in sizes] + [(3, 0)]
    for depth in (2, 3):
        assert delete_folder(spark, c._level_path(whole.folder, depth))
    assert c.load_run(spark, whole.folder).levels == 2
    # the page table is not read again: the index of the first attempt serves
    again = c.crawl(table.limit(0), seeds, scope="external", max_depth=3, folder=whole.folder)
    assert visits(again) == wanted


def exchanged(df):
    """What is read below the exchanges of a plan, and how many there are."""
    lines = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    ).split("\n")
    found, exchanges = [], 0
    for i, line in enumerate(lines):
        if " Exchange " in line:
            exchanges += 1
            depth = line.index("Exchange")
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                if "FileScan" in below:
                    found.append(below)
    return found, exchanges


def test_index_and_levels_are_not_shuffled(spark):
    table = page_table(spark)
    run = c.crawl(table, seed_table(spark, "http://h/", "http://k/"), scope="external", max_depth=1)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = c.store_index(table.limit(0), f"{run.folder}/index", buckets)
    assert index.count() == len(GRAPH)
    level = read_buckets(spark, c._level_path(run.folder, 1), c.VISITED_SCHEMA, "norm", buckets)
    seen = read_buckets(spark, f"{run.folder}/levels", "norm string", "norm", buckets, recursive=True)
    assert seen.count() == run.visited.count()
    assert not {"hrefs", "targets"} & set(level.columns)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = c.expander("external")(level, index)
        assert exchanged(requests) == ([], 0)
        requests.write.mode("overwrite").parquet(f"{run.folder}/requests")
        requests = spark.read.parquet(f"{run.folder}/requests")
        following = c._visit(c.first_visits(requests).join(seen, "norm", "left_anti"), index, None, None, 2)
        scans, exchanges = exchanged(following)
        assert exchanges == 1 and len(scans) == 1 and "parent#" in scans[0] and "Bucketed" not in scans[0]
        assert following.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changed_inputs_of_a_folder_raise(spark):
    table, seeds = page_table(spark), seed_table(spark, "http://h/")
    robots = spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /a\n")], "domain string, text string")
    run = c.crawl(table, seeds, robots=robots)
    assert visits(c.crawl(table, seeds, robots=robots, folder=run.folder)) == visits(run)
    with pytest.raises(ValueError, match="another seeds"):
        c.crawl(table, seed_table(spark, "http://k/"), robots=robots, folder=run.folder)
    with pytest.raises(ValueError, match="another robots"):
        c.crawl(table, seeds, robots=robots.withColumn("text", F.lit("")), folder=run.folder)
    with pytest.raises(ValueError, match="another robots, scope"):
        c.crawl(table, seeds, scope="external", folder=run.folder)


def test_leftovers_of_a_broken_level_are_no_visits(spark):
    table, seeds = page_table(spark), seed_table(spark, "http://h/", "http://k/")
    whole = c.crawl(table, seeds, scope="external", max_depth=2)
    wanted = visits(whole)
    path = c._level_path(whole.folder, 2)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(marker, False)
    again = c.crawl(table, seeds, scope="external", max_depth=2, folder=whole.folder)
    assert visits(again) == wanted


def test_sitemap_pages_come_after_the_seeds(spark):
    docs = spark.createDataFrame(
        [("http://h", "<urlset><url><loc>http://h/d</loc></url><url><loc>http://h/a</loc></url></urlset>")],
        "base_url string, xml string",
    )
    run = c.crawl(page_table(spark), seed_table(spark, "http://h/", "http://h/a"), sitemaps=docs)
    assert [(v[0], v[2]) for v in visits(run)] == [
        ("http://h/", "http://h/"), ("http://h/a", "http://h/a"), ("http://h/d", "http://h/"),
    ]


def test_levels_are_disjoint_and_depth_is_least(spark):
    run = c.crawl(page_table(spark), seed_table(spark, "http://h/", "http://k/"), scope="external", max_depth=4)
    assert run.visited.groupBy("norm").count().where("count > 1").count() == 0
    assert {r["depth"]: r["pages"] for r in c.frontier_sizes(run).collect()}[0] == 2


def test_hot_target_page(spark):
    """A third of all links point at one page: it is visited once, by the first in the queue."""
    rows = [(i, f"http://h/{i}", f'<p>x</p><a href="/hub"></a><a href="/{i + 1}"></a><a href="/n{i}"></a>') for i in range(300)]
    rows.append((300, "http://h/hub", "<p>hub</p>"))
    seeds = seed_table(spark, *[f"http://h/{i}" for i in range(300)])
    run = c.crawl(spark.createDataFrame(rows, PAGE_SCHEMA), seeds, max_depth=1)
    hub = run.visited.where("norm = 'http://h/hub'").collect()
    assert [(r["parent"], r["depth"]) for r in hub] == [("http://h/0", 1)]
    assert run.visited.count() == 602


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1000, 5000])
def test_first_n(spark, n):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"), "id")
    wanted = sorted((r["k"], r["id"]) for r in df.collect())[:n]
    assert sorted((r["k"], r["id"]) for r in first_n(df, n, F.col("k"), F.col("id")).collect()) == wanted


def test_long_robots_lists_give_the_same_crawl(spark):
    """A list of thousands of rules is looked up by prefix; the crawl is that of the short list."""
    few = "User-agent: *\nDisallow: /a\n"
    many = "User-agent: *\n" + "".join(f"Disallow: /none/{i}\n" for i in range(3000)) + "Disallow: /a\n"
    found = []
    for text in (few, many):
        robots = spark.createDataFrame([("http://h", text)], "domain string, text string")
        run = c.crawl(page_table(spark), seed_table(spark, "http://h/"), robots=robots, max_depth=3)
        found.append(sorted((r["url"], r["depth"], r["status"]) for r in run.visited.collect()))
    assert found[0] == found[1] and "robots_blocked" in {s for _, _, s in found[0]}
