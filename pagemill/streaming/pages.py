"""Streams of landed page files: deduplication, extraction and progress.

Without an event time a visit key is remembered for the life of the stream; with one it is
forgotten after a bound.  State lives in the RocksDB store that ``pagemill.session`` selects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions.markup import page_markdown
from pagemill.functions.urls import normalize
from pagemill.operators.extract import Model, extract
from pagemill.operators.flatten import flatten_results, normalize_columns
from pagemill.sinks.export import export
from pagemill.sources.pages import PAGE_SCHEMA
from pagemill.storage import is_folder, write_once

# Seconds per schedule unit.
SCHEDULE_UNITS = {"d": 86400, "h": 3600, "m": 60}
SALTS = 16


def parse_schedule(text: str) -> float:
    """Seconds of ``6h``, ``30m``, ``1d`` or a plain number of seconds."""
    text = text.strip().lower()
    unit = SCHEDULE_UNITS.get(text[-1:])
    return float(text) if unit is None else float(text[:-1]) * unit


def schedule_seconds(text: Column) -> Column:
    """``parse_schedule`` of a column; null where it is no schedule."""
    clean = F.lower(F.trim(text))
    factor = F.lit(1)
    for unit, seconds in SCHEDULE_UNITS.items():
        factor = F.when(F.right(clean, F.lit(1)) == unit, seconds).otherwise(factor)
    return F.regexp_replace(clean, "[dhm]$", "").try_cast("double") * factor


def trigger(schedule: str | None = None) -> dict[str, Any]:
    """Trigger arguments: every ``schedule``, or everything landed so far and then stop."""
    if schedule is None:
        return {"availableNow": True}
    return {"processingTime": f"{int(parse_schedule(schedule) * 1000)} milliseconds"}


def read_page_stream(
    spark: SparkSession, path: str, files: str | None = None, per_trigger: int | None = None, more: str = ""
) -> DataFrame:
    """Pages from files as they land; ``more`` declares further columns, such as an event time.

    ``files`` names the files in ``path``, or a folder there that holds them.
    """
    reader = spark.readStream.schema(f"{PAGE_SCHEMA}, {more}" if more else PAGE_SCHEMA)
    if files is not None and is_folder(spark, f"{path.rstrip('/')}/{files}"):
        path = f"{path.rstrip('/')}/{files}"
    elif files is not None:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def distinct_stream(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """The first page of each visit key over the whole stream, restarts included.

    Copies of one page may make up much of a batch.  They are first dropped within
    ``salts`` random shares, so the task that owns a hot key sees at most one row of each.
    """
    keyed = pages.withColumn("norm", normalize(F.col("url")))
    if salts > 1:
        keyed = (
            keyed.withColumn("_share", (F.rand(seed=7) * salts).cast("int"))
            .dropDuplicates(["norm", "_share"])
            .drop("_share")
        )
    return keyed.dropDuplicates(["norm"])


def distinct_stream_within(pages: DataFrame, event_time: str, bound: str) -> DataFrame:
    """The first page of each visit key, copies being told for at least ``bound`` (as ``"2 days"``) after it.

    One stateful step that forgets a key once the watermark, the latest event time less
    ``bound``, has passed the key's own time plus ``bound``; so the state holds the keys of a
    span of time, not of the whole stream.  Pages older than the watermark are late and dropped,
    and a page that comes again after its key was forgotten is a new one.  Copies within a task
    go before the shuffle, so a hot key sends one row a task and batch.
    """
    keyed = pages.withColumn("norm", normalize(F.col("url")))

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str | None] = set()
        for batch in batches:
            norms = batch.column("norm").to_pylist()
            fresh = []
            for norm in norms:
                fresh.append(norm not in seen)
                seen.add(norm)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return (
        keyed.mapInArrow(first_of_task, keyed.schema)
        .withWatermark(event_time, bound).dropDuplicatesWithinWatermark(["norm"])
    )


def extraction_stream(
    pages: DataFrame,
    model_factory: Callable[[], Model],
    prompt: str,
    item_schema: T.StructType,
    **options: Any,
) -> DataFrame:
    """Pages to flat rows, statelessly; the columns must be declared."""
    read = pages.select(
        "url", F.lit(0).alias("depth"), page_markdown(F.col("html")).alias("markdown")
    )
    results = extract(read, model_factory, prompt, **options)
    return normalize_columns(
        flatten_results(results.where(F.col("data").isNotNull())), schema=item_schema
    )


def page_counts(rows: DataFrame) -> list[Column]:
    """What is counted of every batch by default."""
    counts = [F.count(F.lit(1)).alias("pages")]
    if "html" in rows.columns:
        counts.append(F.count_if(F.col("html").isNull()).alias("without_html"))
    return counts


def read_progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A row of counts for every batch there was, with ``batch_id`` and ``finished_at``."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{checkpoint.rstrip('/')}/progress")


def write_counted(
    rows: DataFrame, output: str, checkpoint: str, counts: list[Column] | None = None,
    schedule: str | None = None, keep: list[str] | None = None,
) -> StreamingQuery:
    """Run ``rows`` into ``output/batch-*``, and the counts of every batch into a table.

    Counts are taken while a batch is written, so each batch is read once.  Rows and counts are
    stored under the batch's number before the batch is committed: a repeated batch replaces
    both, and no batch is lost however many there are.  ``keep`` names the columns to write.
    """
    counted = page_counts(rows) if counts is None else counts
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger(schedule))

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        name = f"batch-{batch_id:06d}"
        out = batch.observe(seen, *counted)
        out.select(*(keep or batch.columns)).write.mode("overwrite").parquet(f"{output.rstrip('/')}/{name}")
        row = [F.lit(v).cast("bigint" if isinstance(v, int) else "string").alias(k) for k, v in seen.get.items()]
        progress = batch.sparkSession.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch_id"), F.current_timestamp().alias("finished_at"), *row
        )
        progress.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/progress/{name}")

    return writer.outputMode("append").foreachBatch(each).start()


def read_exported(spark: SparkSession, output: str, schema: T.StructType) -> DataFrame:
    """The rows that ``write_stream`` exported as JSON; none where every batch was empty."""
    if not is_folder(spark, output):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{output.rstrip('/')}/batch-*.json")


def with_progress(pages: DataFrame, name: str = "progress") -> DataFrame:
    """Counts per batch, delivered to ``StreamingQueryListener`` and ``lastProgress``."""
    return pages.observe(name, *page_counts(pages))


def write_stream(
    rows: DataFrame, output: str, checkpoint: str, schedule: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Run ``rows`` into ``output``; a restart on the same ``checkpoint`` resumes.

    Parquet uses the transactional file sink.  Other formats are exported per batch under
    the batch number, from rows that are computed and stored once, so the model is asked once
    and a repeated batch overwrites itself.  An empty batch writes nothing.
    """
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger(schedule))
    if fmt == "parquet":
        return writer.format("parquet").outputMode("append").start(output)

    def each(batch: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id:06d}"
        stored = write_once(batch.sparkSession, f"{checkpoint.rstrip('/')}/rows/{name}", lambda: batch)
        if not stored.isEmpty():
            export(stored, fmt, output, name)

    return writer.outputMode("append").foreachBatch(each).start()
