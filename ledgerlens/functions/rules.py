"""Ordered keyword rules as column expressions: the first matching rule wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mentions(text: Column, words: Iterable[str]) -> Column:
    """True when the lower-case text contains any of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_match(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    out = None
    for condition, value in rules:
        held = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, held) if out is None else out.when(condition, held)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default)
