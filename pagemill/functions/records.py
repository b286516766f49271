"""Shapes of extracted JSON, over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

_LIST = "array<variant>"
_OBJECT = "map<string,variant>"


def list_values(obj: Column) -> Column:
    """The values of an object that are lists; null when it is not an object."""
    values = F.map_values(obj.try_cast(_OBJECT))
    return F.filter(values, lambda v: v.try_cast(_LIST).isNotNull())


def list_value_count(obj: Column) -> Column:
    lists = list_values(obj)
    return F.when(lists.isNull(), F.lit(0)).otherwise(F.size(lists))


def is_object(value: Column) -> Column:
    return value.try_cast(_OBJECT).isNotNull()


def as_record(value: Column) -> Column:
    """Objects as they are; anything else as ``{"value": …}``."""
    boxed = F.parse_json(F.concat(F.lit('{"value":'), F.to_json(value), F.lit("}")))
    return F.when(is_object(value), value).otherwise(boxed)


def items(value: Column, unwrap: bool = True) -> Column:
    """Rows of one page result as ``ARRAY<VARIANT>``.

    A list gives its items.  With ``unwrap`` an object holding exactly one list gives the
    items of that list.  Everything else is a single row; null gives null.
    """

    single = F.when(value.isNotNull(), F.array(value))

    def with_lists(lists: Column) -> Column:
        return (
            F.when(F.size(lists) == 1, F.get(lists, F.lit(0)).try_cast(_LIST))
            .when(lists.isNotNull(), single)
            .otherwise(F.coalesce(value.try_cast(_LIST), single))
        )

    if unwrap:
        return let(list_values(value), with_lists)
    return F.coalesce(value.try_cast(_LIST), single)
