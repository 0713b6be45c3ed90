"""Arrays, text patterns and tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_element(array: Column) -> Column:
    """First element; null for null and empty arrays."""
    return F.get(array, F.lit(0))


def fields_of(array: Column, field: str, drop_empty: bool = False) -> Column:
    """One text field of each struct of an array; an empty array for null. ``drop_empty`` leaves out null and ''."""
    values = F.coalesce(F.transform(array, lambda x: x[field]), F.array().cast("array<string>"))
    return F.filter(values, lambda x: x.isNotNull() & (x != "")) if drop_empty else values


def holds(text: Column, pattern: str) -> Column:
    """Whether text contains the pattern, ignoring case; % and _ in it are wildcards and a backslash is itself."""
    return F.call_function("like", F.lower(text), F.lower(F.lit(f"%{pattern}%")), F.lit("\x01"))


def or_else(*values: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def safe_long(text: Column) -> Column:
    return text.cast("string").try_cast("long")


def present(*columns: Column) -> Column:
    """Whether all columns are neither null nor empty text."""
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull() & (c.cast("string") != "")
    return test
