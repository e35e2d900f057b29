"""Operational reports over trail and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import ALERT_RULES, AlertRule


def duration_histogram(durations: DataFrame, buckets: Sequence[float], by: str = "name", value: str = "seconds") -> DataFrame:
    """Cumulative counts per upper bound (NULL: no bound), with the sum and count of all values.

    All buckets are conditional counts of one aggregation; values never multiply.
    """
    counts = [F.count_if(F.col(value) <= le).alias(f"_b{i}") for i, le in enumerate(buckets)]
    agg = durations.filter(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("count"), F.sum(value).alias("sum"), *counts
    )
    rows = [F.struct(F.lit(float(le)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, le in enumerate(buckets)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("cumulative")))
    return agg.select(by, "count", "sum", F.inline(F.array(*rows)))


def review_queue(flags: DataFrame, as_of: str) -> DataFrame:
    """Per severity: pending flags, their mean age in hours, reviewed on the day, mean review seconds."""
    now = F.lit(as_of).cast("timestamp")
    reviewed = F.coalesce("reviewed", F.lit(False))
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(3_600_000_000.0)
    took = (F.unix_micros("review_timestamp") - F.unix_micros("created_at")) / F.lit(1_000_000.0)
    today = reviewed & (F.to_date("review_timestamp") == F.to_date(now))
    return flags.filter(F.col("created_at") <= now).groupBy("severity_level").agg(
        F.count_if(~reviewed).alias("pending"),
        F.avg(F.when(~reviewed, age)).alias("mean_age_hours"),
        F.count_if(F.coalesce(today, F.lit(False))).alias("reviewed_today"),
        F.avg(F.when(reviewed, took)).alias("mean_review_seconds"),
    )


def _reviewed_rate():
    reviewed = F.coalesce("reviewed", F.lit(False))
    false = F.count_if(reviewed & F.coalesce(F.col("human_decision") == "false_positive", F.lit(False)))
    return F.try_divide(false, F.count_if(reviewed))


def audit_overview(runs: DataFrame, flags: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row for the last ``hours``: runs, completed, mean duration, transactions, flags per severity, cost,
    false-positive rate of the last seven days and of the week before.

    ``runs``: audit_run_id, workflow_status, finished_at, duration_seconds, transactions, cost_dollars.
    """
    now = F.lit(as_of).cast("timestamp")

    def within(df: DataFrame, column: str, start_h: int, end_h: int = 0) -> DataFrame:
        lo, hi = now - F.expr(f"interval {start_h} hours"), now - F.expr(f"interval {end_h} hours")
        return df.filter((F.col(column) > lo) & (F.col(column) <= hi))

    done = F.col("workflow_status") == "completed"
    recent = within(flags, "created_at", hours)
    levels = recent.agg(
        F.count("*").alias("flags"),
        *[F.count_if(F.col("severity_level") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")],
    )
    week = 7 * 24
    return within(runs, "finished_at", hours).agg(
        F.count("*").alias("audits"),
        F.count_if(done).alias("completed"),
        F.avg(F.when(done, F.col("duration_seconds"))).alias("mean_duration_seconds"),
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"),
        F.coalesce(F.sum("cost_dollars"), F.lit(0)).alias("cost_dollars"),
    ).select(
        "*",
        *[levels.select(c).scalar().alias(c) for c in ("flags", "critical", "warning", "info")],
        within(flags, "created_at", week).agg(_reviewed_rate()).scalar().alias("fp_rate"),
        within(flags, "created_at", 2 * week, week).agg(_reviewed_rate()).scalar().alias("fp_rate_week_before"),
    )


def weekly_false_positive_rate(flags: DataFrame) -> DataFrame:
    """Per calendar week the false-positive rate and the rate of the week before; one row per week."""
    weekly = flags.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(_reviewed_rate().alias("fp_rate"))
    return weekly.withColumn("previous_fp_rate", F.lag("fp_rate").over(Window.orderBy("week")))


def step_success(trail: DataFrame) -> DataFrame:
    """Per step: runs, share without an error, mean seconds."""
    return trail.groupBy("agent_name").agg(
        F.count("*").alias("runs"),
        F.try_divide(F.count_if(F.col("error_message").isNull()), F.count("*")).alias("success_rate"),
        (F.avg("execution_time_ms") / F.lit(1000)).alias("mean_seconds"),
    )


def alert_hits(metrics: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    """Metrics (metric, label, value) that break a rule. The rules become one expression over the metrics."""
    hits = []
    for r in rules:
        value = F.col("value")
        broken = value > r.threshold if r.op == ">" else value < r.threshold
        hit = F.struct(F.lit(r.name).alias("alert"), F.lit(r.threshold).alias("threshold"))
        hits.append(F.when((F.col("metric") == r.metric) & broken, hit))
    return metrics.select("metric", "label", "value", F.inline(F.array_compact(F.array(*hits))))


def detector_quality(flags: DataFrame, factor: str = "high_anomaly_score") -> DataFrame:
    """Precision and recall of one factor from reviewed flags: a reviewed flag that is no false positive is a
    true case."""
    fired = F.array_contains("factors", factor)
    true = ~F.coalesce(F.col("human_decision") == "false_positive", F.lit(False))
    counts = flags.filter(F.coalesce("reviewed", F.lit(False))).agg(
        F.count_if(fired & true).alias("tp"), F.count_if(fired & ~true).alias("fp"), F.count_if(~fired & true).alias("fn")
    )
    return counts.select(
        F.lit(factor).alias("detector"),
        "tp",
        "fp",
        "fn",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
