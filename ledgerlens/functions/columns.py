"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: str | Column) -> Column:
    """NaN becomes NULL, so that one notion of 'missing' holds everywhere."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def missing(df, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def days_apart(a: str | Column, b: str | Column) -> Column:
    """Whole days between two timestamps: floor of a-b, then absolute (so -3.5 days is 4)."""
    return F.abs(F.floor((micros(a) - micros(b)) / F.lit(DAY_US)))


def relative_gap(a: str | Column, b: str | Column) -> Column:
    """|a-b| / |a|, NULL when a is 0."""
    a, b = col(a), col(b)
    return F.try_divide(F.abs(a - b), F.abs(a))


def stable_bucket(c: str | Column, buckets: int) -> Column:
    """Reproducible bucket from the first 8 hex digits of the md5."""
    return F.pmod(F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_fraction(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from the md5 of the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def labels_where(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Array with the label of every condition that is true (NULL counts as false)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def points_where(pairs: Sequence[tuple[Column, float]]) -> Column:
    """Sum of the points of every condition that is true."""
    total = F.lit(0)
    for cond, points in pairs:
        total = total + F.when(cond, F.lit(points)).otherwise(F.lit(0))
    return total


def money(c: str | Column) -> Column:
    """Two decimals; a missing number prints as nan."""
    c = clean_number(c)
    return F.when(c.isNotNull(), F.format_string("%.2f", c)).otherwise(F.lit("nan"))
