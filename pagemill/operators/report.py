"""Run counters, failed pages and the result preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.crawl import FAILED, OK

# Preview and failure listing sizes.
PREVIEW_ROWS, PREVIEW_COLUMNS, CELL_CHARS, SHOWN_FAILURES = 8, 6, 50, 5


def run_counters(log: DataFrame, elapsed: float = 0.0, output_path: str = "") -> DataFrame:
    """One row of counts from ``(url, status)``.

    The failed addresses themselves stay a table (see ``first_failures``): a list of them in
    one cell would grow with the run.
    """
    return log.agg(
        F.count_if(F.col("status") == OK).alias("pages_scraped"),
        F.count_if(F.col("status").isin(*FAILED)).alias("pages_failed"),
    ).select(
        "pages_scraped",
        "pages_failed",
        F.lit(round(elapsed, 2)).alias("elapsed_seconds"),
        F.lit(output_path).alias("output_path"),
    )


def summary_lines(counters: DataFrame, at: Column | None = None) -> DataFrame:
    """The run summary as text lines, of the time ``at`` or of now.  Fixed values: the labels."""
    at = F.current_timestamp() if at is None else at
    line = F.array(
        F.concat(F.lit("Pages crawled:  "), F.col("pages_scraped").cast("string")),
        F.concat(F.lit("Pages failed:   "), F.col("pages_failed").cast("string")),
        F.format_string("Time:           %.1fs", F.col("elapsed_seconds").cast("double")),
        F.concat(F.lit("Output:         "), F.col("output_path")),
        F.concat(F.lit("Timestamp:      "), F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
    )
    return counters.select(F.posexplode(line).alias("line_no", "value"))


def first_failures(log: DataFrame, *order: str, n: int = SHOWN_FAILURES) -> DataFrame:
    """The first failed pages in the given order: a top-k, nothing is collected."""
    return log.where(F.col("status").isin(*FAILED)).orderBy(*order).limit(n)


def preview(rows: DataFrame, *order: str) -> DataFrame:
    """The first rows and columns with short cells, plus how many rows are not shown."""
    columns = [c for c in rows.columns if c not in order][:PREVIEW_COLUMNS]

    def cell(name: str):
        kind = dict(rows.dtypes)[name]
        nested = kind.startswith(("array", "struct", "map", "variant"))
        text = F.to_json(F.col(f"`{name}`")) if nested else F.col(f"`{name}`").cast("string")
        return F.substring(F.coalesce(text, F.lit("")), 1, CELL_CHARS).alias(name)

    shown = rows.orderBy(*order).limit(PREVIEW_ROWS)
    return shown.select(*[F.col(f"`{o}`") for o in order], *[cell(c) for c in columns])


def rows_not_shown(rows: DataFrame) -> DataFrame:
    return rows.agg(F.greatest(F.count(F.lit(1)) - PREVIEW_ROWS, F.lit(0)).alias("more_rows"))
