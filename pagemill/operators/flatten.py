"""Page results to rows, and rows to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.records import as_record, items, list_value_count
from pagemill.operators.rows import explode_with_position

SOURCE_COLUMN, DEPTH_COLUMN = "_source_url", "_crawl_depth"


def flatten_results(
    results: DataFrame, *, unwrap: bool = True, provenance: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """One row per extracted item: ``item VARIANT`` plus where it came from.

    ``results`` has JSON text in ``data`` and, for provenance, ``source_url`` and ``depth``;
    missing ones become an empty address and depth 0.  Text that is not JSON gives no row.
    """
    value = F.try_parse_json("data")
    carried = [F.col(c) for c in keep or []]
    if provenance:
        url = F.col("source_url") if "source_url" in results.columns else F.lit(None)
        depth = F.col("depth") if "depth" in results.columns else F.lit(None)
        carried += [
            F.coalesce(url.cast("string"), F.lit("")).alias(SOURCE_COLUMN),
            F.coalesce(depth.cast("int"), F.lit(0)).alias(DEPTH_COLUMN),
        ]
    parsed = results.withColumn("_value", value)
    exploded = explode_with_position(parsed, carried, items(F.col("_value"), unwrap), "item_pos", "item")
    return exploded.withColumn("item", as_record(F.col("item")))


def api_rows(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows as the service interface returns them: lists extended, objects whole."""
    return flatten_results(results, unwrap=False, provenance=False, keep=keep)


def preview_rows(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows as the preview shows them: unwrapped, without provenance."""
    return flatten_results(results, unwrap=True, provenance=False, keep=keep)


def list_value_counts(results: DataFrame) -> DataFrame:
    value = F.try_parse_json("data")
    return results.withColumn("list_values", list_value_count(value))


# The kinds of VARIANT numbers that are whole or exact.
_WHOLE = ("TINYINT", "SMALLINT", "INT", "BIGINT")
_ELEMENT, _KEY = "[]", "."
_MERGED = "VARIANT|DECIMAL|DOUBLE|FLOAT|DATE|TIMESTAMP"
MAX_KEYS = 10_000


def _kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY`` or the type of a scalar; JSON's null is ``VOID``."""
    return F.coalesce(F.substring_index(F.schema_of_variant(value), "<", 1), F.lit("VOID"))


def _entries(value: Column, kind: Column) -> Column:
    """``array<struct<step, value>>`` of an object's keys or a list's items."""
    of_object = F.transform(
        F.map_entries(value.try_cast("map<string,variant>")),
        lambda e: F.struct(F.concat(F.lit(_KEY), e["key"]).alias("step"), e["value"].alias("value")),
    )
    of_list = F.transform(
        value.try_cast("array<variant>"), lambda v: F.struct(F.lit(_ELEMENT).alias("step"), v.alias("value"))
    )
    return F.when(kind == "OBJECT", of_object).otherwise(of_list)


def _one_of_each_shape(rows: DataFrame, item: str) -> DataFrame:
    """``value``: an item of every shape, which has all paths and kinds of the items of that shape.

    Inside lists a shape is the union of the elements'; where numbers, times or unlike elements
    were merged in one, it does not tell which kinds there are, and all such items stay.
    """
    shaped = rows.select(F.col(f"`{item}`").alias("value")).withColumn("shape", F.schema_of_variant("value"))
    merged = F.coalesce(F.col("shape").contains("ARRAY<") & F.col("shape").rlike(_MERGED), F.lit(False))
    one = shaped.where(~merged).groupBy("shape").agg(F.first("value").alias("value"))
    return one.select("value").unionByName(shaped.where(merged).select("value"))


def _kinds(rows: DataFrame, item: str, max_keys: int) -> dict[tuple[str, ...], set[str]]:
    """The kinds of value found at every path, looked for level by level.

    Values are counted by path and kind where they are, so a level sends a row for each path and
    kind, however many items there are.  More than ``max_keys`` paths are an error: keys that
    are data belong into rows, not into columns.
    """
    # kept by Spark, not in files: those may hold whole numbers beside decimals as decimals
    few = _one_of_each_shape(rows, item).persist()
    level = few.select(F.array().cast("array<string>").alias("path"), "value")
    level = level.withColumn("kind", _kind(F.col("value")))
    found: dict[tuple[str, ...], set[str]] = {}
    try:
        while True:
            inner = level.where(F.col("kind").isin("OBJECT", "ARRAY")).select(
                "path", F.explode(_entries(F.col("value"), F.col("kind"))).alias("e")
            )
            level = inner.select(
                F.array_append("path", F.col("e.step")).alias("path"), F.col("e.value").alias("value")
            ).withColumn("kind", _kind(F.col("value")))
            here = level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).select("path", "kind")
            more = False
            for r in here.limit(40 * max_keys).collect():  # a path has some forty kinds at most
                found.setdefault(tuple(r["path"]), set()).add(r["kind"])
                more |= r["kind"] in ("OBJECT", "ARRAY")
            if len(found) > max_keys:
                raise ValueError(f"more than {max_keys} keys in the items; raise max_keys or unwrap keys that are data")
            if not more:
                return found
    finally:
        few.unpersist()


def _settled(path: tuple[str, ...], found: dict[tuple[str, ...], set[str]], below: dict[tuple[str, ...], list[str]]) -> T.DataType:
    """Column type for the kinds at a path: fractions are doubles, open questions and conflicts are text."""
    kinds = found.get(path, set()) - {"VOID"}
    steps = below.get(path, [])
    if kinds == {"OBJECT"}:
        fields = [T.StructField(s[1:], _settled((*path, s), found, below)) for s in steps]
        # inside a list, names that differ in case only can not stand side by side
        clash = _ELEMENT in path and len({f.name.lower() for f in fields}) < len(fields)
        return T.StructType(fields) if fields and not clash else T.StringType()
    if kinds == {"ARRAY"}:
        return T.ArrayType(_settled((*path, _ELEMENT), found, below))
    exact = {k for k in kinds if k in _WHOLE or k.startswith("DECIMAL")}
    if kinds and kinds == exact:
        sizes = [tuple(map(int, k[8:-1].split(","))) for k in kinds if k.startswith("DECIMAL")]
        if any(scale for _, scale in sizes):
            return T.DoubleType()
        return T.DecimalType(38, 0) if any(digits > 18 for digits, _ in sizes) else T.LongType()
    if kinds - exact in ({"DOUBLE"}, {"FLOAT"}, {"DOUBLE", "FLOAT"}):
        return T.DoubleType()
    if len(kinds) == 1 and not kinds & {"OBJECT", "ARRAY"}:
        return T.DataType.fromDDL(next(iter(kinds)))
    return T.StringType()


def infer_item_schema(rows: DataFrame, item: str = "item", max_keys: int = MAX_KEYS) -> T.StructType:
    """Union of the keys of all rows; only paths and kinds reach the driver, ``max_keys`` of them at most.

    Any text can be a key; keys that differ in case only are different keys.
    """
    found = _kinds(rows, item, max_keys)
    below: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(found):
        below.setdefault(path[:-1], []).append(path[-1])
    fields = [T.StructField(s[1:], _settled((s,), found, below)) for s in below.get((), []) if s != _ELEMENT]
    return T.StructType(fields)


def _at(item: Column, path: tuple[str, ...]) -> Column:
    """The VARIANT at a path of keys, each of which may be any text."""
    steps = "$"
    for key in path:
        if "'" in key and '"' in key:  # no path can be written for it
            inner = item if steps == "$" else F.try_variant_get(item, steps, "variant")
            item, steps = F.try_element_at(inner.try_cast("map<string,variant>"), F.lit(key)), "$"
        else:
            steps += f"['{key}']" if "'" not in key else f'["{key}"]'
    return item if steps == "$" else F.try_variant_get(item, steps, "variant")


def _leaves(schema: T.StructType, names: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    found = []
    for field in schema.fields:
        here = (*names, field.name)
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, here)
        else:
            found.append((here, field.dataType))
    return found


def distinct_names(names: list[str], taken: list[str] | None = None) -> list[str]:
    """``names``, those equal but for case to an earlier one with ``_2``, ``_3``, … appended."""
    used = {t.lower() for t in taken or []}
    out = []
    for name in names:
        n, free = 2, name
        while free.lower() in used:
            free, n = f"{name}_{n}", n + 1
        used.add(free.lower())
        out.append(free)
    return out


def discovered_keys(rows: DataFrame, item: str = "item") -> list[tuple[str, str]]:
    """Dotted column names and types over all rows."""
    schema = infer_item_schema(rows, item)
    return [(".".join(path), kind.simpleString()) for path, kind in _leaves(schema)]


def normalize_columns(
    rows: DataFrame, item: str = "item", schema: T.StructType | None = None
) -> DataFrame:
    """Nested objects as dotted columns, lists as arrays; other columns kept, last.

    Columns are the union of keys in alphabetical order.  Streams must pass ``schema``.  Without
    it ``rows`` are read once for every level of keys, so they should be stored.
    Keys of ``rows`` itself (provenance) win over payload keys of the same name; payload keys
    whose names differ in case only, or are dotted alike, stay apart (``distinct_names``).
    """
    schema = infer_item_schema(rows, item) if schema is None else schema
    others = [c for c in rows.columns if c not in (item, "item_pos")]
    picked: list[Column] = []
    leaves = [(path, kind) for path, kind in _leaves(schema) if ".".join(path) not in others]
    names = distinct_names([".".join(path) for path, _ in leaves], others)
    for name, (path, kind) in zip(names, leaves, strict=True):
        picked.append(_at(F.col(f"`{item}`"), path).try_cast(kind).alias(name))
    return rows.select(*picked, *[F.col(f"`{c}`") for c in others])


def union_rows(*frames: DataFrame) -> DataFrame:
    """Row union over differing keys; a missing key is null."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
