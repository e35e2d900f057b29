"""Streams of rows, of ids delivered again, and of quality by the hour. The audit and the reconciliation of streams have modules of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import missing
from ..params import REQUIRED_FIELDS


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_duplicates(txns: DataFrame, time_col: str = "date", watermark: str = "7 days") -> DataFrame:
    """Drop re-delivered ids. Ids are kept as state for the watermark only; a copy that comes later passes."""
    return txns.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["txn_id"])


def stream_panes(txns: DataFrame, time_col: str = "date", watermark: str = "1 day", width: str = "1 hour", fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Rows and missing values of every required field per event-time pane (``window``). An absent field is missing in every row."""
    lacking = [(F.count_if(missing(txns, f)) if f in txns.columns else F.count("*")).alias(f"missing_{f}") for f in fields]
    return txns.withWatermark(time_col, watermark).groupBy(F.window(time_col, width)).agg(F.count("*").alias("rows"), *lacking)


def with_score(panes: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Start and end of each window, its counts and the share of filled cells, rounded as in the batch."""
    absent = sum((F.col(f"missing_{f}") for f in fields), F.lit(0))
    return panes.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "rows",
        *[f"missing_{f}" for f in fields],
        F.round(1 - F.try_divide(absent, F.col("rows") * len(fields)), 3).alias("completeness_score"),
    )


def stream_quality(txns: DataFrame, time_col: str = "date", watermark: str = "1 day", width: str = "1 hour", fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Quality per tumbling window. In append mode a window comes out once the watermark passes it; later rows are dropped."""
    return with_score(stream_panes(txns, time_col, watermark, width, fields), fields)


def stream_quality_overview(
    txns: DataFrame, time_col: str = "date", watermark: str = "1 day", width: str = "1 hour", span: str = "24 hours", fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Quality over the last ``span``, a new window every ``width``: finished panes are added up, so a row is aggregated once and
    the sliding windows only see one row for each pane. The second aggregation follows the panes by their window time."""
    panes = stream_panes(txns, time_col, watermark, width, fields)
    sums = [F.sum(c).alias(c) for c in ("rows", *(f"missing_{f}" for f in fields))]
    return with_score(panes.groupBy(F.window(F.window_time("window"), span, width)).agg(*sums), fields)
