"""Slices, incomplete and suspicious rows, first occurrences, display caps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_number, missing
from ..functions.skew import join_unique
from ..params import LIVE_REQUIRED_FIELDS


def source_date_slice(txns: DataFrame, source: str, start: str, end: str) -> DataFrame:
    """One source between two timestamps; a date-only end is midnight, so later times that day are out."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return txns.filter((F.col("source") == source) & F.col("date").between(lo, hi))


def is_incomplete(df: DataFrame, fields: Sequence[str] = LIVE_REQUIRED_FIELDS):
    present = [missing(df, f) for f in fields if f in df.columns]
    return reduce(lambda a, b: a | b, present, F.lit(False))


def incomplete_rows(df: DataFrame, fields: Sequence[str] = LIVE_REQUIRED_FIELDS) -> DataFrame:
    """Rows where a required field is missing; absent columns are skipped."""
    return df.filter(is_incomplete(df, fields))


def high_value_unreconciled(txns: DataFrame, unmatched_ids: DataFrame, min_amount: float = 5000.0) -> DataFrame:
    """Rows of at least ``min_amount`` that the reconciliation did not already report as unmatched."""
    large = txns.filter(F.coalesce(clean_number("amount") >= min_amount, F.lit(False)))
    return join_unique(large, unmatched_ids.select("txn_id").distinct(), ["txn_id"], "left_anti")


def suspicious_transactions(
    txns: DataFrame,
    unmatched: DataFrame,
    incomplete: DataFrame,
    duplicated: DataFrame,
    anomalous: DataFrame | None = None,
    include_anomalies: bool = False,
) -> DataFrame:
    """All rows, copies included, whose id is in any of the id sets."""
    sets = [unmatched, incomplete, duplicated]
    if include_anomalies and anomalous is not None:
        sets.append(anomalous)
    ids = reduce(DataFrame.unionByName, [s.select("txn_id") for s in sets]).distinct()
    return join_unique(txns, ids, ["txn_id"], "left_semi")


def first_per_txn(txns: DataFrame, order: Sequence[str] = ("date",)) -> DataFrame:
    """One row per txn_id: the smallest in ``order``, then by all other columns.

    A ``min`` over a struct combines on the map side, so an id with very many copies costs one row per task.
    """
    rest = [c for c in txns.columns if c != "txn_id" and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_r")
    return txns.groupBy("txn_id").agg(first).select("txn_id", "_r.*").select(*txns.columns)


def cap_per_result(df: DataFrame, n: int, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Display option: the first ``n`` rows, overall or per group. Nothing in the engine applies it."""
    if not by:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
