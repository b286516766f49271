"""Writers for result tables.

Every format is written by all tasks at once into a folder ``<dir>/<name>.<ending>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.flatten import distinct_names

# Table and element names, and the marker of an empty result.
SQL_TABLE, XML_ROOT, XML_ROW, EMPTY_MARKER = "scraped_data", "data", "record", "_empty"
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def with_empty_marker(rows: DataFrame) -> DataFrame:
    """``rows``, or the single row ``{_empty: true}`` when there is none."""
    found = rows.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n"))
    marker = found.where(F.col("n") == 0).select(F.lit(True).alias(EMPTY_MARKER))
    return rows.unionByName(marker, allowMissingColumns=True)


def marked_if_empty(rows: DataFrame) -> DataFrame:
    """As exported: the marker column exists only in an empty export."""
    return with_empty_marker(rows).select(EMPTY_MARKER) if rows.isEmpty() else rows


def nested_as_json(rows: DataFrame) -> DataFrame:
    """Lists and objects as JSON text, for formats whose cells are flat."""

    def cell(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        return F.to_json(column).alias(field.name) if isinstance(field.dataType, _NESTED) else column

    return rows.select(*[cell(f) for f in rows.schema.fields])


def write_json(rows: DataFrame, path: str) -> str:
    """JSON Lines; nulls are written, text is not escaped to ASCII."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_csv(rows: DataFrame, path: str) -> str:
    (nested_as_json(rows).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", "").csv(path))
    return path


def xml_name(name: str) -> str:
    clean = re.sub(r"[^\w.\-]", "_", name)
    return clean if re.match(r"[A-Za-z_]", clean) else f"_{clean}"


def write_xml(rows: DataFrame, path: str) -> str:
    flat = nested_as_json(rows)
    named = flat.toDF(*distinct_names([xml_name(c) for c in flat.columns]))
    (named.write.mode("overwrite").format("xml")
     .option("rootTag", XML_ROOT).option("rowTag", XML_ROW).save(path))
    return path


def write_table(rows: DataFrame, table: str = SQL_TABLE, path: str | None = None) -> str:
    writer = nested_as_json(rows).write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return table


def write_jdbc(rows: DataFrame, url: str, table: str = SQL_TABLE, **options: str) -> str:
    nested_as_json(rows).write.mode("overwrite").format("jdbc").options(
        url=url, dbtable=table, **options
    ).save()
    return table


def markdown_lines(rows: DataFrame) -> DataFrame:
    """A markdown table as text lines: header, rule, one line per row.

    The header is a partition of its own in front, so the part files in name order are one
    valid table whatever their number.
    """
    flat = nested_as_json(rows)

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\s*[\r\n]+\s*", " ")

    def line(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    names = [c.replace("|", r"\|") for c in flat.columns]
    head = ["| " + " | ".join(names) + " |", "|" + "|".join(" --- " for _ in names) + "|"]
    top = rows.sparkSession.range(1, numPartitions=1).select(
        F.explode(F.array(*[F.lit(h) for h in head])).alias("value")
    )
    return top.union(flat.select(line([cell(c) for c in flat.columns]).alias("value")))


def write_markdown(rows: DataFrame, path: str) -> str:
    markdown_lines(rows).write.mode("overwrite").text(path)
    return path


_WRITERS = {
    "json": (write_json, "json"),
    "csv": (write_csv, "csv"),
    "xml": (write_xml, "xml"),
    "markdown": (write_markdown, "md"),
}
FORMATS = ("json", "csv", "xml", "sql", "markdown")


def export(
    rows: DataFrame, fmt: str, output_dir: str = "output", filename: str = SQL_TABLE, table: str | None = None
) -> str:
    """Write ``rows`` in the named format and return the path or table written.

    The SQL table is called ``table``, or else like the file.
    """
    fmt = fmt.strip().lower()
    if fmt not in FORMATS:
        raise ValueError(f"No writer for {fmt!r}; there is one for each of {', '.join(FORMATS)}")
    rows = marked_if_empty(rows)
    if fmt == "sql":
        name = table or re.sub(r"\W", "_", filename)
        return write_table(rows, name, f"{output_dir.rstrip('/')}/{filename}.table")
    writer, ending = _WRITERS[fmt]
    return writer(rows, f"{output_dir.rstrip('/')}/{filename}.{ending}")


def write_summary(lines: DataFrame, output_dir: str) -> str:
    path = f"{output_dir.rstrip('/')}/run_summary"
    lines.orderBy("line_no").coalesce(1).select("value").write.mode("overwrite").text(path)
    return path
