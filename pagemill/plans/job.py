"""A whole job: crawl, extract, flatten, export, summarize.

A job keeps its state in a folder: what it depends on, crawl levels, model answers, items.  Run
again on that folder it goes on where it was broken off, and refuses if what it depends on has
changed.  A job that resumes from another job's folder visits only what that one has not
settled, and exports the results of both.  When a job is done, what only served to go on is
removed; ``JobResult.cleanup`` removes the rest.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.markup import page_markdown
from pagemill.functions.urls import url_key
from pagemill.operators.crawl import EXTRACT_FAILED, OK, VISITED_SCHEMA, CrawlRun, crawl, load_run
from pagemill.operators.extract import RESULT_SCHEMA, Model, extract, split_results
from pagemill.operators.flatten import flatten_results, normalize_columns
from pagemill.operators.report import run_counters, summary_lines
from pagemill.operators.typed import load_schema, prompt_suffix, to_struct, typed_columns
from pagemill.sinks.export import export, write_summary
from pagemill.sources import cache
from pagemill.sources.seeds import seeds as as_seeds
from pagemill.storage import delete_folder, is_complete, new_folder, same_manifest, write_once


@dataclass(frozen=True)
class JobSpec:
    """What to visit, what to ask for and where to put it."""

    prompt: str
    start_url: str = ""
    start_urls: Any = None
    scope: str = "same_domain"
    max_depth: int = 0
    max_pages: int | None = None
    output_format: str = "json"
    output_dir: str = "output"
    schema: str = ""
    provider: str | None = None
    agent: str = "pagemill"
    cache_dir: str | None = None
    retry_failed: bool = False
    parallelism: int | None = None
    shards: int = 1
    concurrency: int = 1
    run_dir: str | None = None
    """Folder of the job's state; a new one by default."""
    resume_from: str | None = None
    """Folder of an earlier job whose results are to be kept and whose pages are not to be visited again."""
    pages_version: str | None = None
    """What tells versions of the page table apart; by default their ids and addresses do."""
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class JobResult:
    run: CrawlRun
    results: DataFrame
    log: DataFrame
    rows: DataFrame
    output_path: str
    folder: str

    def cleanup(self) -> bool:
        """Remove the job's state: it can not be resumed any more, and only ``output_path`` remains."""
        return delete_folder(self.rows.sparkSession, self.folder)


def page_content(visited: DataFrame, pages: DataFrame, cache_dir: str | None = None) -> DataFrame:
    """``(url, depth, markdown, hit)`` of visited pages; cached markdown is used if there is some."""
    asked = visited.where(F.col("status").isin(OK, EXTRACT_FAILED)).select("url", "depth", "page_id")

    def converted(wanted: DataFrame) -> DataFrame:
        found = wanted.join(pages.select("page_id", "html"), "page_id")
        return found.select(
            "url", "depth", page_markdown(F.col("html")).alias("markdown"), F.lit(False).alias("hit")
        )

    if cache_dir is None:
        return converted(asked)
    # slim rows look in the cache; html moves for the misses only
    looked = cache.look_up(asked, cache.read_cache(visited.sparkSession, cache_dir, asked))
    hits = looked.where("hit").select("url", "depth", F.col("cached").alias("markdown"), "hit")
    return hits.unionByName(converted(looked.where(~F.col("hit")).select("url", "depth", "page_id")))


def _shard(spec: JobSpec):
    return F.pmod(F.xxhash64("url"), F.lit(spec.shards)).cast("int")


def stored_content(spec: JobSpec, visited: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """``page_content`` with its ``shard``: stored by shard where it is read several times.

    Pages that the cache did not have are put into it, under the name of this job, so that a
    repeated job leaves the cache as it was.
    """
    spark = pages.sparkSession
    content = page_content(visited, pages, spec.cache_dir).withColumn("shard", _shard(spec))
    if spec.cache_dir is None and spec.shards == 1:
        return content
    path = f"{folder}/content"
    if not is_complete(spark, path):
        content.write.mode("overwrite").partitionBy("shard").parquet(path)
    stored = spark.read.schema("url string, depth int, markdown string, hit boolean, shard int").parquet(path)
    if spec.cache_dir is not None:
        run = spark.range(1).select(url_key(F.lit(folder)).alias("k")).first()["k"]
        cache.put(cache.cache_rows(stored.where(~F.col("hit"))), spec.cache_dir, f"run-{run}")
    return stored


def answers(
    spec: JobSpec, content: Callable[[], DataFrame], spark: SparkSession, model_factory: Callable[[], Model],
    prompt: str, folder: str,
) -> DataFrame:
    """The model's answers in ``spec.shards`` parts by address, each stored once.

    A job that is run again on its folder asks only for the parts it had not finished.
    """
    paths = _answer_paths(folder, spec.shards)
    missing = [k for k, path in enumerate(paths) if not is_complete(spark, path)]
    texts = content() if missing else None
    for k in missing:
        write_once(spark, paths[k], lambda k=k: extract(
            texts.where(F.col("shard") == k), model_factory, prompt, provider=spec.provider,
            parallelism=spec.parallelism, concurrency=spec.concurrency,
        ))
    return spark.read.schema(RESULT_SCHEMA).parquet(*paths)


def _answer_paths(folder: str, shards: int) -> list[str]:
    return [f"{folder}/results/part-{k:04d}-of-{shards:04d}" for k in range(shards)]


def job_log(visited: DataFrame, unanswered: DataFrame) -> DataFrame:
    """``visited``, pages without a result being failed."""
    none = unanswered.select(F.col("source_url").alias("url"), F.lit(True).alias("_no_result"))
    status = F.when((F.col("status") == OK) & F.col("_no_result"), EXTRACT_FAILED).otherwise(F.col("status"))
    return visited.join(none, "url", "left").withColumn("status", status).select(*visited.columns)


def load_job(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages that an earlier job settled, with their states, and the answers it has.

    Pages that it visited without asking the model, because it was broken off, are not settled.
    """
    none = spark.createDataFrame([], VISITED_SCHEMA), spark.createDataFrame([], RESULT_SCHEMA)
    if not is_complete(spark, f"{folder}/job"):
        return none
    manifest = {r["name"]: r["value"] for r in spark.read.parquet(f"{folder}/job").collect()}  # a row an option
    paths = [p for p in _answer_paths(folder, json.loads(manifest["shards"])) if is_complete(spark, p)]
    given = spark.read.schema(RESULT_SCHEMA).parquet(*paths) if paths else none[1]
    visited = load_run(spark, folder).visited
    asked = F.col("status").isin(OK, EXTRACT_FAILED)
    settled = visited.where(~asked).unionByName(
        visited.where(asked).join(given.select(F.col("source_url").alias("url")), "url", "left_semi").select(*visited.columns)
    )
    log = job_log(settled, split_results(given)[1])
    if is_complete(spark, f"{folder}/earlier-log"):
        log = log.unionByName(spark.read.schema(VISITED_SCHEMA).parquet(f"{folder}/earlier-log"))
        given = given.unionByName(spark.read.schema(RESULT_SCHEMA).parquet(f"{folder}/earlier-results"))
    return log, given


def run_job(
    spec: JobSpec,
    pages: DataFrame,
    model_factory: Callable[[], Model],
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    visited: DataFrame | None = None,
) -> JobResult:
    started = time.time()
    spark = pages.sparkSession
    schema = load_schema(spec.schema)
    prompt = spec.prompt + (prompt_suffix(schema) if schema else "")
    options = dict(spec.extra)
    folder = options.pop("folder", None) or spec.run_dir or new_folder(spark, "job")
    depends = {name: getattr(spec, name) for name in (
        "schema", "provider", "shards", "scope", "max_depth", "max_pages", "retry_failed", "resume_from", "cache_dir",
        "pages_version",
    )}
    inputs = {} if spec.pages_version is not None else {"pages": pages.select("page_id", "url")}
    same_manifest(spark, f"{folder}/job", {**depends, "prompt": spec.prompt}, inputs, "job")

    earlier_results = None
    if spec.resume_from is not None:
        log, given = load_job(spark, spec.resume_from)
        earlier_log = write_once(spark, f"{folder}/earlier-log", lambda: log)
        earlier_results = write_once(spark, f"{folder}/earlier-results", lambda: split_results(given)[0])
        visited = earlier_log if visited is None else visited.select(*earlier_log.columns).unionByName(earlier_log)
    run = crawl(
        pages,
        as_seeds(spark, spec.start_urls, spec.start_url),
        robots=robots, sitemaps=sitemaps, agent=spec.agent, scope=spec.scope,
        max_depth=spec.max_depth, max_pages=spec.max_pages, visited=visited,
        retry_failed=spec.retry_failed, folder=folder, **options,
    )
    answered = answers(
        spec, lambda: stored_content(spec, run.visited, pages, folder), spark, model_factory, prompt, folder
    )
    results, unanswered = split_results(answered)
    log = job_log(run.visited, unanswered)
    if earlier_results is not None:
        results = results.unionByName(earlier_results)
        log = log.unionByName(earlier_log.join(run.visited.select("norm"), "norm", "left_anti").select(*log.columns))
    log = log.select("url", "status", "depth", "rank")
    items = write_once(spark, f"{folder}/items", lambda: flatten_results(results)).drop("item_pos")
    rows = typed_columns(items, to_struct(schema)) if schema else normalize_columns(items)
    path = export(rows, spec.output_format, spec.output_dir)
    counters = run_counters(log, time.time() - started, path)
    write_summary(summary_lines(counters), spec.output_dir)
    for part in ("index", "content", "rules", "hot-domains"):
        delete_folder(spark, f"{folder}/{part}")
    return JobResult(run, results, log, rows, path, folder)
