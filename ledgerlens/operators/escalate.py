"""Severity, explanations, escalation rules, flags and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_number, labels_where, money, points_where
from ..functions.skew import join_unique
from ..params import EXPLANATIONS, FALLBACK_EXPLANATION, FULL_SEVERITY, TOOL_SEVERITY, SeverityParams
from .anomaly import rolling_deviation


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _level(score: Column, p: SeverityParams) -> Column:
    return (
        F.when(score >= p.critical, F.lit("CRITICAL")).when(score >= p.warning, F.lit("WARNING")).otherwise(F.lit("INFO"))
    )


def _score(df: DataFrame, factors: list[tuple[Column, str]], p: SeverityParams) -> DataFrame:
    score = points_where([(cond, p.weights[name]) for cond, name in factors])
    scored = df.withColumns({"_score": score, "factors": labels_where(factors)})
    confidence = F.round(F.least(F.size("factors") / F.lit(3), F.lit(1.0)), 2)
    return scored.withColumns(
        {
            "severity_score": F.least("_score", F.lit(100)),
            "severity_level": _level(F.col("_score"), p),
            "confidence_score": confidence,
        }
    ).drop("_score")


def severity_live(txns: DataFrame, p: SeverityParams = SeverityParams()) -> DataFrame:
    """Score rows that carry is_unmatched, is_incomplete, is_duplicate and amount.

    Dropped: rows without a factor, and rows whose only factor is a missing match below the high amount.
    A missing amount is neither high nor small.
    """
    high = F.coalesce(clean_number("amount") >= p.high_amount, F.lit(False))
    small = F.coalesce(clean_number("amount") < p.high_amount, F.lit(False))
    scored = _score(
        txns,
        [
            (_true("is_unmatched"), "no_reconciliation_match"),
            (_true("is_incomplete"), "incomplete_data"),
            (_true("is_duplicate"), "duplicate_transaction"),
            (high, "high_amount"),
        ],
        p,
    )
    only_unmatched = (F.size("factors") == 1) & F.array_contains("factors", "no_reconciliation_match")
    return scored.filter((F.size("factors") > 0) & ~(only_unmatched & small))


def severity_tool(txns: DataFrame, p: SeverityParams = TOOL_SEVERITY) -> DataFrame:
    """Score rows that carry matched, incomplete and amount; every row gets a level."""
    return _score(
        txns,
        [
            (~_true("matched"), "no_reconciliation_match"),
            (_true("incomplete"), "incomplete_data"),
            (F.coalesce(clean_number("amount") > p.high_amount, F.lit(False)), "high_amount"),
        ],
        p,
    )


def severity_full(txns: DataFrame, p: SeverityParams = FULL_SEVERITY, high_risk: int = 70) -> DataFrame:
    """Score rows that carry matched, anomaly_score, email_approval and receipt_found.

    ``below_info`` marks rows under the INFO cut of the rules.
    """
    scored = _score(
        txns,
        [
            (~_true("matched"), "no_reconciliation_match"),
            (F.coalesce(F.col("anomaly_score") > high_risk, F.lit(False)), "high_anomaly_score"),
            (~_true("email_approval"), "no_email_approval"),
            (~_true("receipt_found"), "no_receipt"),
        ],
        p,
    )
    return scored.withColumn("below_info", F.col("severity_score") < p.info)


def explain(df: DataFrame) -> DataFrame:
    """Adds ``explanation`` from ``factors``, txn_id, amount and vendor."""
    amount = money("amount")
    vendor = F.coalesce("vendor", F.lit("Unknown"))

    def reason(template: str) -> Column:
        text = F.lit(template)
        for mark, value in (("{amount}", amount), ("{vendor}", vendor), ("{txn_id}", F.col("txn_id"))):
            if mark in template:
                text = F.replace(text, F.lit(mark), value)
        return text

    reasons = F.array_compact(
        F.array(*[F.when(F.array_contains("factors", name), reason(t)) for name, t in EXPLANATIONS.items()])
    )
    text = F.concat(F.lit("Flagged because: "), F.array_join(reasons, "; "), F.lit("."))
    return df.withColumn("explanation", F.when(F.size(reasons) > 0, text).otherwise(F.lit(FALLBACK_EXPLANATION)))


def escalation_rules(
    scored: DataFrame,
    whitelist: DataFrame | None = None,
    mode: str = "live",
    cfo_above: float = 1000.0,
    auto_approve_below: float = 50.0,
) -> DataFrame:
    """Adjust ``severity_level`` and add ``cfo_notice``.

    Whitelisted vendors: WARNING becomes INFO. INFO below the small amount becomes AUTO_APPROVED; in "live"
    mode that also applies to a vendor downgraded just before, in "tool" mode only to rows that came as INFO.
    """
    if mode not in ("live", "tool"):
        raise ValueError("mode must be live or tool")
    if whitelist is None:
        listed = scored.withColumn("_listed", F.lit(False))
    else:
        names = whitelist.filter("vendor is not null").select("vendor").distinct().withColumn("_listed", F.lit(True))
        listed = join_unique(scored, names, ["vendor"])
    level = F.col("severity_level")
    down = _true("_listed") & (level == "WARNING")
    after = F.when(down, F.lit("INFO")).otherwise(level)
    small = F.coalesce(F.col("amount") < auto_approve_below, F.lit(False))
    eligible = (after if mode == "live" else level) == "INFO"
    notice = (level == "CRITICAL") & F.coalesce(clean_number("amount") > cfo_above, F.lit(False))
    final = F.when(eligible & small, F.lit("AUTO_APPROVED")).otherwise(after)
    return listed.withColumns({"cfo_notice": notice, "severity_level": final}).drop("_listed").select(
        *scored.columns, "cfo_notice"
    )


def recurring_downgrade(scored: DataFrame, txns: DataFrame, pct: float = 5.0, min_rows: int = 3) -> DataFrame:
    """One level down for recurring vendors (at least ``min_rows`` payments) whose payment stays within
    ``pct`` percent of the trailing mean."""
    sizes = (
        txns.filter("vendor_id is not null and amount is not null and date is not null")
        .groupBy("vendor_id")
        .agg(F.count("*").alias("_n"))
    )
    recurring = sizes.filter(F.col("_n") >= min_rows).select("vendor_id", F.lit(True).alias("_recurring"))
    off = rolling_deviation(txns, pct=pct, min_rows=min_rows, inclusive=True)
    off = off.select("txn_id").distinct().withColumn("_off", F.lit(True))
    joined = join_unique(join_unique(scored, recurring, ["vendor_id"]), off, ["txn_id"])
    down = _true("_recurring") & ~_true("_off") & F.col("amount").isNotNull() & F.col("date").isNotNull()
    level = F.col("severity_level")
    lower = F.when(level == "CRITICAL", F.lit("WARNING")).when(level == "WARNING", F.lit("INFO")).otherwise(level)
    return joined.withColumn("severity_level", F.when(down, lower).otherwise(level)).select(*scored.columns)


def flag_id(run_id: Column, txn_id: Column) -> Column:
    """UUID-shaped and the same on every retry."""
    h = F.sha2(F.concat_ws("|", run_id, txn_id), 256)
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def create_flags(explained: DataFrame, audit_run_id: str, created_at: str) -> DataFrame:
    """Flag rows from one scored and explained row per transaction; AUTO_APPROVED rows make no flag."""
    evidence = F.to_json(
        F.struct(
            (~F.array_contains("factors", "no_reconciliation_match")).alias("matched"),
            F.array_contains("factors", "high_amount").alias("high_amount"),
            F.coalesce("vendor", F.lit("Unknown")).alias("vendor"),
            F.col("factors").alias("contributing_factors"),
        )
    )
    run = F.lit(audit_run_id)
    return explained.filter(F.col("severity_level") != "AUTO_APPROVED").select(
        flag_id(run, F.col("txn_id")).alias("flag_id"),
        F.col("txn_id").alias("transaction_id"),
        run.alias("audit_run_id"),
        "severity_level",
        "confidence_score",
        "explanation",
        "factors",
        evidence.alias("supporting_evidence_links"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def audit_summary(
    audit_run_id: str, txns: DataFrame, flags: DataFrame, suspicious_rows: DataFrame | None = None, status: str = "completed"
) -> DataFrame:
    """One row: transactions, suspicious rows (one-row frame with column n), flags per severity, flag rate."""
    processed = txns.agg(F.count("*")).scalar()
    suspicious = F.lit(None).cast("bigint") if suspicious_rows is None else suspicious_rows.select("n").scalar()

    def level(name: str) -> Column:
        return F.count_if(F.col("severity_level") == name)

    return flags.agg(
        F.count("*").alias("flags_created"),
        level("CRITICAL").alias("critical"),
        level("WARNING").alias("warning"),
        level("INFO").alias("info"),
    ).select(
        F.lit(audit_run_id).alias("audit_run_id"),
        F.lit(status).alias("status"),
        processed.alias("transactions_processed"),
        suspicious.alias("suspicious_transactions"),
        "flags_created",
        "critical",
        "warning",
        "info",
        F.round(F.coalesce(F.try_divide(F.col("flags_created"), processed), F.lit(0.0)), 4).alias("flag_rate"),
    )
