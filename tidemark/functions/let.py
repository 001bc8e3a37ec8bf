"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being written and computed once. A column that an expression uses several times is
    otherwise written out at each place, and nested uses multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
