"""Helpers for operators that stay in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldseam.llm.common import WHITE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use refers to it, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, which the six ASCII white-space characters end; none if it is null."""
    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))
