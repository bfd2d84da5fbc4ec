"""Bind an intermediate value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain column reference may be inlined by the optimizer wherever it is used; a lambda
    variable is not, so costly text work is neither repeated nor copied into filters.
    """
    return F.transform(F.array(value), body)[0]
