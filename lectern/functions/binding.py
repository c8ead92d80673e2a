"""Evaluate an expression once and name it.

A lambda body is evaluated per element, and whatever expression it mentions is
evaluated with it. Passing the value through `let` makes it a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(size: Column, start: int = 0) -> Column:
    """0..size-1 (or from `start`), empty when size is not positive."""
    return F.when(size > 0, F.sequence(F.lit(start), size + (start - 1))).otherwise(F.array().cast("array<int>"))
