"""From raw layouts to the one gold transaction schema, and the slices an audit reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import clean_number
from ..functions.skew import number_rows

_RENAMES = {
    "credit_card": {"expense_id": "txn_id", "expense_date": "date", "merchant": "vendor"},
    "bank": {"transaction_date": "date", "description": "vendor"},
    "receipts": {"receipt_id": "txn_id", "receipt_date": "date", "vendor_name": "vendor"},
}


def synth_bank_ids(bank: DataFrame) -> DataFrame:
    """Bank rows carry no id: number them ``BANK_000001``... by date, description, amount, running balance.

    Files have no row order in Spark, so the order is by value; exact copies get consecutive numbers.
    """
    first = ["transaction_date", "description", "amount", "running_balance"]
    order = first + [c for c in bank.columns if c not in first]
    numbered = number_rows(bank, [], order, "row")
    width = F.greatest(F.lit(6), F.length(F.col("row").cast("string")))
    return numbered.select(
        F.concat(F.lit("BANK_"), F.lpad(F.col("row").cast("string"), width, F.lit("0"))).alias("txn_id"),
        *bank.columns,
    )


def to_gold(df: DataFrame, source_type: str) -> DataFrame:
    """Gold columns first, every other raw column after them. NaN amounts become NULL here."""
    if source_type not in _RENAMES:
        raise ValueError(f"unknown source type: {source_type}")
    if source_type == "bank" and "txn_id" not in df.columns:
        df = synth_bank_ids(df)
    df = df.withColumnsRenamed(_RENAMES[source_type]).withColumn("source", F.lit(source_type))
    if "vendor_id" not in df.columns:
        df = df.withColumn("vendor_id", F.lit(None).cast("string"))
    df = df.withColumns({"amount": clean_number("amount"), "date": F.col("date").cast("timestamp")})
    extra = [c for c in df.columns if c not in schemas.GOLD_COLUMNS]
    return df.select(*schemas.GOLD_COLUMNS, *extra)


def gold_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def transactions_for_audit(cards: DataFrame, since: datetime | str, limit: int | None = None) -> DataFrame:
    """Card rows of the audit period in the gold layout, with the optional columns that exist."""
    gold = to_gold(cards.filter(F.col("expense_date") >= F.lit(since).cast("timestamp")), "credit_card")
    keep = [c for c in schemas.OPTIONAL_CARD_COLUMNS if c in gold.columns]
    gold = gold.select(*schemas.GOLD_COLUMNS, *keep)
    if limit is not None:
        gold = gold.orderBy("date", "txn_id").limit(limit)
    return gold


def in_range(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive on both ends; a date-only end means midnight of that day."""
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(date_col) <= F.lit(end).cast("timestamp"))
    return df


def bank_in_range(bank: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return to_gold(in_range(bank, "transaction_date", start, end), "bank")


def receipts_in_range(receipts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return to_gold(in_range(receipts, "receipt_date", start, end), "receipts")


def last_audit_timestamp(workflow_state: DataFrame, default: str = "2025-01-01") -> DataFrame:
    """Start of the newest completed run, or ``default``."""
    done = F.when(F.col("workflow_status") == "completed", F.col("created_at"))
    return workflow_state.agg(
        F.coalesce(F.max(done), F.lit(default).cast("timestamp")).alias("last_audit_timestamp")
    )


def new_transactions(
    txns: DataFrame, since: str, limit: int | None = None, created_col: str = "created_at"
) -> DataFrame:
    """Rows created strictly after ``since``; with ``limit`` the oldest ones, in order."""
    fresh = txns.filter(F.col(created_col) > F.lit(since).cast("timestamp"))
    return fresh if limit is None else fresh.orderBy(created_col, "txn_id").limit(limit)
