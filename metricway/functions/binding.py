"""A value computed once and used many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value). An expression named inside a lambda is worked out again for every element;
    bound this way it is worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)
