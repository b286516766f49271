"""Bind an expression once, use it many times.

Inside a higher-order function Catalyst evaluates a referenced expression again for
every element.  ``let`` puts the value in a lambda variable, so it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
