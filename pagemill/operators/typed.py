"""Declared output shapes: a field map or a JSON Schema to a Spark type, applied to items."""

from __future__ import annotations

import json
import logging
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)

# Type names of field maps and of JSON Schema.
_SCALARS = {
    "str": T.StringType(), "string": T.StringType(),
    "int": T.LongType(), "integer": T.LongType(),
    "float": T.DoubleType(), "number": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "list": T.ArrayType(T.StringType()), "array": T.ArrayType(T.StringType()),
}

_WORDS = {T.StringType: "text", T.LongType: "whole number", T.DoubleType: "number", T.BooleanType: "true or false"}
CORRUPT_COLUMN = "_corrupt"


def load_schema(path_or_json: str) -> dict | None:
    """A schema from a file or from JSON text; ``None`` if there is none or it is broken."""
    if not path_or_json:
        return None
    text = path_or_json
    if os.path.isfile(path_or_json):
        with open(path_or_json, encoding="utf-8") as f:
            text = f.read()
    try:
        schema = json.loads(text)
    except json.JSONDecodeError:
        schema = None
    if not isinstance(schema, dict):
        logger.warning("Neither a field map nor a JSON Schema: %s", path_or_json[:100])
        return None
    return schema


def _row_node(schema: dict) -> dict | None:
    """The part of a JSON Schema that describes one row; ``None`` for a field map."""
    inner = schema.get("items")
    node = inner if isinstance(inner, dict) else schema
    return node if isinstance(schema.get("type"), (str, list)) and isinstance(node.get("properties"), dict) else None


def _described(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "{" + ", ".join(f"{f.name}: {_described(f.dataType)}" for f in kind.fields) + "}"
    if isinstance(kind, T.ArrayType):
        return f"list of {_described(kind.elementType)}"
    return _WORDS[type(kind)]


def prompt_suffix(schema: dict) -> str:
    """What is added to the user's prompt so that the model keeps to the row type."""
    lines = [f"- {f.name} ({_described(f.dataType)})" for f in to_struct(schema).fields]
    return "\n".join(["", "", "Reply with one JSON array and nothing else. Every element is an object with:", *lines])


def _json_schema_type(node: dict[str, Any]) -> T.DataType:
    kind = node.get("type", "string")
    if isinstance(kind, list):  # ["string", "null"]
        kind = next((k for k in kind if k != "null"), "string")
    if kind == "object" and node.get("properties"):
        return T.StructType(
            [T.StructField(n, _json_schema_type(p)) for n, p in node["properties"].items()]
        )
    if kind == "array" and "items" in node:
        return T.ArrayType(_json_schema_type(node["items"]))
    return _SCALARS.get(kind, T.StringType())


def to_struct(schema: dict) -> T.StructType:
    """Row type: of a JSON Schema with an array root it is that of its items."""
    node = _row_node(schema)
    if node is not None:
        return T.StructType([T.StructField(n, _json_schema_type(p)) for n, p in node["properties"].items()])
    return T.StructType(
        [T.StructField(n, _SCALARS.get(str(k).lower(), T.StringType())) for n, k in schema.items()]
    )


def typed_columns(rows: DataFrame, schema: T.StructType, item: str = "item") -> DataFrame:
    """``item`` as the declared columns; what does not fit is null and flags the row.

    Each field is cast by itself, so one bad value costs one cell; ``_corrupt`` keeps the
    item's JSON when any present field did not fit.
    """
    typed, bad = [], F.lit(False)
    for field in schema.fields:
        quote = '"' if "'" in field.name else "'"
        where = f"$[{quote}{field.name}{quote}]"
        value = F.try_variant_get(item, where, field.dataType.simpleString())
        raw = F.try_variant_get(item, where, "variant")
        present = raw.isNotNull() & ~F.is_variant_null(raw)
        bad = bad | (present & value.isNull())
        typed.append(value.alias(field.name))
    others = [F.col(f"`{c}`") for c in rows.columns if c != item and c not in schema.names]
    corrupt = F.when(bad, F.to_json(F.col(item))).alias(CORRUPT_COLUMN)
    return rows.select(*typed, corrupt, *others)
