"""Null, text and ratio helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    """``''`` and NULL both mean "no id"; keep only NULL."""
    return F.nullif(value, F.lit(""))


def is_present(value: Column) -> Column:
    """True for a non-blank id. NULL stays NULL, which a filter drops."""
    return value != ""


def is_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def is_false(flag: Column) -> Column:
    """``flag IS FALSE``: NULL is not false."""
    return ~F.coalesce(flag, F.lit(True))


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def relative_change(new: Column, old: Column) -> Column:
    """``(new - old) / old``, NULL when it cannot be computed."""
    return F.try_divide(F.try_subtract(new, old), old)


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over the rows meeting the condition; NULL when there are none."""
    return F.sum(F.when(condition, value))


def any_true(condition: Column) -> Column:
    """Whether a group has a row meeting the condition; NULL conditions count as no."""
    return F.max(F.coalesce(condition, F.lit(False)))


def two_digits(number: Column) -> Column:
    """Pad one-character numbers to two; longer ones are left whole."""
    text = number.cast("string")
    return F.when(F.length(text) == 1, F.concat(F.lit("0"), text)).otherwise(text)


def json_text(value: Column) -> Column:
    """JSON text of a value, the word ``null`` when there is none."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    """Whether the upper-cased text holds any of the fragments; NULL text stays NULL."""
    condition = F.lit(False)
    for fragment in fragments:
        condition = condition | F.contains(F.upper(text), F.lit(fragment.upper()))
    return condition


def split_field(text: Column, separator: str, position: int) -> Column:
    """Zero-based field of a separated text; a missing field raises, as a wrong subscript should."""
    return F.split(text, "[" + separator + "]")[position]
