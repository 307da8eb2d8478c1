"""Small helpers for native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def texts(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def words_of(text: Column, between: str) -> Column:
    """Non-empty parts of a text between matches of a regular expression."""
    return F.filter(F.split(text, between), lambda w: w != "")
