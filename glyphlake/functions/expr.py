"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_some(*options: Column) -> Column:
    return F.coalesce(*options)


def blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(~text.rlike("(?U)\\S"), F.lit(True))
