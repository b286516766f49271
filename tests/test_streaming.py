"""Streams against the batch operators on the same files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.flatten import flatten_results, normalize_columns
from pagemill.plans import catalog
from pagemill.plans.doubles import heading_model
from pagemill.operators.extract import extract
from pagemill.functions.markup import page_markdown
from pagemill.sources.pages import PAGE_SCHEMA, distinct_pages
from pagemill.streaming import pages as s
from pagemill.streaming.pages import distinct_stream_within, read_page_stream, read_progress, write_counted, write_stream


@pytest.mark.parametrize("text, seconds", [("6h", 21600), ("30m", 1800), (" 1D ", 86400), ("45", 45), ("1.5h", 5400)])
def test_schedule(text, seconds):
    assert s.parse_schedule(text) == seconds
    assert s.trigger(text) == {"processingTime": f"{seconds * 1000} milliseconds"}


def test_no_schedule_runs_once():
    assert s.trigger() == {"availableNow": True}


def run(rows, folder, **options):
    q = s.write_stream(rows, f"{folder}/out", f"{folder}/state", **options)
    q.awaitTermination()
    return q


@pytest.mark.parametrize("salts", [1, 16])
def test_dedup_over_restarts_equals_batch(spark, sf_dir, tmp_path, salts):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    landed = str(tmp_path / "landed")
    half = pages.where("page_id < 25")
    # a third of the rows are copies of one page
    hot = half.where("page_id = 0").select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"), "*").drop("i")
    half.unionByName(hot).write.parquet(landed)
    rows = s.distinct_stream(s.read_page_stream(spark, landed), salts).select("norm", "url")
    run(rows, tmp_path)
    pages.write.mode("append").parquet(landed)
    run(rows, tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    wanted = distinct_pages(pages).select("norm")
    assert out.count() == wanted.count()
    assert out.select("norm").exceptAll(wanted).count() == 0
    run(rows, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == wanted.count()


SHAPE = T.StructType([T.StructField("title", T.StringType()), T.StructField("links", T.LongType())])


def test_extraction_equals_batch(spark, sf_dir, tmp_path):
    stream = s.read_page_stream(spark, sf_dir, "pages.parquet")
    run(s.extraction_stream(stream, heading_model, "title", SHAPE), tmp_path)
    read = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "url", F.lit(0).alias("depth"), page_markdown(F.col("html")).alias("markdown")
    )
    batch = normalize_columns(flatten_results(extract(read, heading_model, "title")), schema=SHAPE)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == batch.columns
    assert out.exceptAll(batch).count() == 0 and out.count() == batch.count() == 50


def test_other_formats_are_exported_per_batch(spark, sf_dir, tmp_path):
    rows = s.read_page_stream(spark, sf_dir, "pages.parquet").select("page_id", "url")
    run(rows, tmp_path, fmt="csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/batch-000000.csv").count() == 50


def test_model_is_asked_once_a_page_in_any_format(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        import tempfile

        def model(text, url, prompt):
            tempfile.mkstemp(dir=calls)
            return {"title": text}

        return model

    landed = str(tmp_path / "landed")
    spark.createDataFrame([(i, f"http://h/{i}", f"<p>text {i}</p>") for i in range(6)], "page_id long, url string, html string").write.parquet(landed)
    shape = T.StructType([T.StructField("title", T.StringType())])
    rows = s.extraction_stream(s.read_page_stream(spark, landed), factory, "title", shape)
    run(rows, tmp_path, fmt="json")
    run(rows, tmp_path, fmt="json")  # nothing new: no batch, no marker
    assert spark.read.json(f"{tmp_path}/out/batch-*.json").count() == 6
    assert len(list(calls.iterdir())) == 6


def test_progress(spark, sf_dir, tmp_path):
    rows = s.with_progress(s.read_page_stream(spark, sf_dir, "pages.parquet"), "seen").select("page_id")
    q = run(rows, tmp_path)
    counts = [p.observedMetrics["seen"] for p in q.recentProgress if "seen" in p.observedMetrics]
    assert sum(c["pages"] for c in counts) == 50 and sum(c["without_html"] for c in counts) == 0


def test_progress_of_more_batches_than_spark_remembers(spark, tmp_path):
    rows = spark.range(105).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"),
                                   F.when(F.col("id") % 5 != 0, "<p>x</p>").alias("html"))
    rows.repartitionByRange(105, "page_id").write.parquet(str(tmp_path / "in"))
    n = len(list((tmp_path / "in").glob("part-*.parquet")))
    stream = read_page_stream(spark, str(tmp_path / "in"), per_trigger=1)
    write_counted(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=["page_id"]).awaitTermination()
    seen = read_progress(spark, str(tmp_path / "state"))
    total = seen.agg(F.count("*"), F.sum("pages"), F.sum("without_html"), F.max("batch_id")).first()
    assert n > 100 and tuple(total) == (n, 105, 21, n - 1)
    assert spark.read.parquet(str(tmp_path / "out" / "batch-*")).count() == 105
    # a restart goes on, and an old batch is not counted again
    write_counted(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=["page_id"]).awaitTermination()
    assert read_progress(spark, str(tmp_path / "state")).count() == n


def test_bounded_dedup_has_one_stateful_step_and_forgets(spark, tmp_path):
    pages = spark.createDataFrame([(i % 4, f"http://h/{i % 4}/", "x") for i in range(400)], PAGE_SCHEMA)
    pages.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    late = pages.limit(1).select(F.lit(9).cast("long").alias("page_id"), F.lit("http://h/9").alias("url"), "html")
    for day in (2, 3, 4, 5):  # each is a batch: a key goes at the end of the batch that begins past its time
        late.withColumn("at", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_page_stream(spark, str(tmp_path / "in"), per_trigger=1, more="at timestamp")
    rows = distinct_stream_within(stream, "at", "1 hour")
    q = write_stream(rows.select("norm"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    out = sorted(r["norm"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == ["http://h/0", "http://h/1", "http://h/2", "http://h/3", "http://h/9", "http://h/9"]
    last = q.lastProgress["stateOperators"]
    assert len(last) == 1 and last[0]["numRowsTotal"] <= 1


def test_pages_in_a_folder_of_files(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    wanted = pages.select("url").orderBy("url").collect()
    for name in ("stream_extract", "stream_export_json"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).select("url").orderBy("url").collect() == wanted, name
    assert catalog.stream_dedup(spark, str(tmp_path)).count() == distinct_pages(pages).count() > 0


def test_export_of_no_pages_has_no_rows(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/pages.parquet").limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    out = catalog.stream_export_json(spark, str(tmp_path))
    assert out.columns == ["title", "links", "url", "depth"] and out.count() == 0


def test_bounded_dedup_lands_pages_as_many_files(spark, sf_dir, tmp_path, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(catalog, "new_folder", lambda spark, purpose: str(tmp_path / purpose))
    out = catalog.stream_dedup_bounded(spark, str(tmp_path)).collect()
    norms = {r["norm"] for r in distinct_pages(pages).select("norm").collect()}
    assert sorted((r["norm"], r["minute"]) for r in out if r["minute"] in (0, 302)) == sorted((n, m) for n in norms for m in (0, 302))
    assert sorted(r["minute"] for r in out if r["minute"] not in (0, 302)) == [300, 301]
    # three times all pages, and two of one page
    assert len(list((tmp_path / "stream" / "landed").glob("part-*.parquet"))) > 3 + 2
