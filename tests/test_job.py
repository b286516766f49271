"""A whole job, from seeds to the written table, its cache and its resumption."""

import json
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill import JobSpec, load_run, run_job
from pagemill.plans.doubles import heading_model
from pagemill.sources.cache import read_cache
from pagemill.sources.pages import PAGE_SCHEMA
from pagemill.storage import delete_folder, new_folder, shared_root

# workers cannot import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES = [
    (0, "http://h/", '<h1>Home</h1><a href="/a">a</a><a href="/blank">b</a><a href="/gone">g</a>'),
    (1, "http://h/a", '<h1>A</h1><a href="/">home</a>'),
    (2, "http://h/blank", "<script>1</script>"),
    (3, "http://k/", "<h1>Other</h1>"),
]


def test_job(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    spec = JobSpec(
        prompt="Get the title", start_url="http://h/", max_depth=1, output_format="json",
        output_dir=str(tmp_path / "out"), cache_dir=str(tmp_path / "cache"),
    )
    done = run_job(spec, pages, heading_model)
    rows = [r.asDict() for r in spark.read.json(done.output_path).orderBy("_source_url").collect()]
    assert rows == [
        {"links": 3, "title": "Home", "_source_url": "http://h/", "_crawl_depth": 0},
        {"links": 1, "title": "A", "_source_url": "http://h/a", "_crawl_depth": 1},
    ]
    states = dict(done.log.select("url", "status").collect())
    assert states == {
        "http://h/": "ok", "http://h/a": "ok", "http://h/blank": "extract_failed", "http://h/gone": "fetch_failed",
    }
    summary = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "run_summary")).collect()]
    assert summary[:2] == ["Pages crawled:  2", "Pages failed:   2"]
    cached = read_cache(spark, str(tmp_path / "cache"))
    assert cached.count() == 2

    # the cached text is used instead of the page, and the cache does not grow
    changed = pages.withColumn("html", F.regexp_replace("html", "Home", "Changed"))
    again = run_job(spec, changed, heading_model)
    titles = [r["title"] for r in again.rows.orderBy("_source_url").collect()]
    assert titles == ["Home", "A"]
    assert read_cache(spark, str(tmp_path / "cache")).count() == 2


def test_job_with_schema_and_resume(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    first = run_job(
        JobSpec("t", start_urls=["http://h/"], output_dir=str(tmp_path / "1"), schema='{"title": "str", "links": "str"}'),
        pages, heading_model,
    )
    assert [tuple(r) for r in first.rows.select("title", "links").collect()] == [("Home", "3")]
    visited = load_run(spark, first.run.folder).visited
    second = run_job(
        JobSpec("t", start_urls=["http://h/", "http://k/"], output_dir=str(tmp_path / "2")),
        pages, heading_model, visited=visited,
    )
    assert [r["title"] for r in second.rows.collect()] == ["Other"]


def titles(done):
    return sorted(tuple(r) for r in done.rows.select("title", "_source_url").collect())


def prompt_model():
    return lambda source, url, prompt: {"title": prompt, "links": 0}


def test_changed_jobs_on_one_folder_raise(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    spec = JobSpec("first", start_url="http://h/", output_dir=str(tmp_path / "out"), run_dir=str(tmp_path / "run"))
    done = run_job(spec, pages, prompt_model)
    assert titles(done) == titles(run_job(spec, pages, prompt_model)) == [("first", "http://h/")]
    for change in (
        {"prompt": "second"}, {"start_url": "http://k/"}, {"schema": '{"title": "str"}'}, {"max_depth": 1},
        {"shards": 2}, {"provider": "openai"},
    ):
        with pytest.raises(ValueError, match="another"):
            run_job(replace(spec, **change), pages, prompt_model)
    with pytest.raises(ValueError, match="another pages"):
        run_job(spec, pages.where("page_id < 3"), prompt_model)
    assert done.cleanup()
    assert titles(run_job(replace(spec, prompt="second"), pages, prompt_model)) == [("second", "http://h/")]


def test_finished_jobs_leave_no_index_and_repeat_without_pages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    spec = JobSpec(
        "t", start_url="http://h/", max_depth=1, output_dir=str(tmp_path / "out"), run_dir=str(tmp_path / "run"),
        cache_dir=str(tmp_path / "cache"), shards=3, pages_version="v1",
    )
    done = run_job(spec, pages, heading_model)
    left = {p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")}
    assert left == {"job", "options", "levels", "results", "items"}
    def no_model():
        raise AssertionError("asked again")

    again = run_job(spec, pages.limit(0), no_model)
    assert titles(again) == titles(done) and read_cache(spark, str(tmp_path / "cache")).count() == 2


def test_broken_off_job_asks_only_for_missing_parts_and_keeps_the_cache(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    spec = JobSpec(
        "t", start_url="http://h/", max_depth=1, output_dir=str(tmp_path / "out"), run_dir=str(tmp_path / "run"),
        cache_dir=str(tmp_path / "cache"), shards=2,
    )
    done = run_job(spec, pages, heading_model)
    before, wanted = read_cache(spark, spec.cache_dir).count(), titles(done)
    for gone in ("results/part-0001-of-0002", "items"):
        assert delete_folder(spark, f"{done.folder}/{gone}")
    assert titles(run_job(spec, pages, heading_model)) == wanted
    assert read_cache(spark, spec.cache_dir).count() == before == 2


def test_results_of_an_earlier_job_are_merged(spark, tmp_path):
    def no_title():
        def run(source, url, prompt):
            if url.endswith("/a"):
                raise RuntimeError("no quota")
            return {"title": "old " + url}

        return run

    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    first = run_job(JobSpec("t", start_urls=["http://h/", "http://h/a", "http://gone/"], output_dir=str(tmp_path / "1")), pages, no_title)
    spec = JobSpec("t", start_urls=["http://h/", "http://h/a", "http://k/"], output_dir=str(tmp_path / "2"), resume_from=first.folder)
    second = run_job(spec, pages, heading_model)
    assert titles(second) == [("Other", "http://k/"), ("old http://h/", "http://h/")]
    assert dict(second.log.select("url", "status").collect()) == {
        "http://h/": "ok", "http://h/a": "extract_failed", "http://gone/": "fetch_failed", "http://k/": "ok",
    }
    # what failed is asked for again, and the third job needs the second one's folder only
    assert first.cleanup()
    third = run_job(replace(spec, resume_from=second.folder, retry_failed=True, output_dir=str(tmp_path / "3")), pages, heading_model)
    assert titles(third) == [("A", "http://h/a"), ("Other", "http://k/"), ("old http://h/", "http://h/")]
    assert dict(third.log.select("url", "status").collect())["http://h/a"] == "ok"


def test_failing_model_marks_pages_failed(spark, tmp_path):
    def broken():
        def run(source, url, prompt):
            raise RuntimeError("no quota")

        return run

    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    done = run_job(JobSpec("t", start_url="http://h/a", output_dir=str(tmp_path)), pages, broken)
    assert dict(done.log.select("url", "status").collect()) == {"http://h/a": "extract_failed"}
    written = [json.loads(l) for f in (tmp_path / "scraped_data.json").glob("part*") for l in f.read_text().splitlines()]
    assert written == [{"_empty": True}]


def test_intermediate_tables_go_to_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root.rstrip("/")
    assert new_folder(spark, "x").startswith(f"{root}/pagemill/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")
