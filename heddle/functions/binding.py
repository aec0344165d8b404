"""Evaluating a Column once where an expression needs it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``; unlike plain reuse inside a lambda, the value is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
