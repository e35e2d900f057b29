"""The audit runs: the live one (quality, reconciliation, severity, flags), and the full one with anomalies and context."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from ..functions.columns import clean_number
from ..operators.anomaly import anomaly_features, anomaly_report, build_vendor_profiles, late_payments
from ..operators.context import enriched_transactions
from ..operators.escalate import audit_summary, create_flags, escalation_rules, explain, severity_full, severity_live
from ..operators.filters import is_incomplete
from ..operators.iforest import isolation_forest_fit_score
from ..operators.matching import match_one_to_one
from ..operators.quality import completeness, quality_gate
from ..operators.trail import decision_log
from ..params import FULL_SEVERITY, AnomalyParams, MatchParams, SeverityParams


@dataclass(frozen=True)
class AuditResult:
    flags: DataFrame
    pairs: DataFrame
    per_txn: DataFrame
    quality: DataFrame
    summary: DataFrame


def transaction_findings(cards: DataFrame, pairs: DataFrame, high_amount: float = 5000.0) -> DataFrame:
    """One row per txn_id: its first row (by date, then amount), how many rows share the id, and the findings
    is_unmatched, is_incomplete, is_duplicate.

    Everything that belongs to an id is one aggregation, which combines copies before the shuffle; the
    matched ids come from a single join on a unique key. Amounts of at least ``high_amount`` count as
    unmatched even if a partner exists.
    """
    cards = cards.withColumn("amount", clean_number("amount"))
    per_txn = cards.groupBy("txn_id").agg(
        F.count("*").alias("rows"),
        F.max(is_incomplete(cards)).alias("is_incomplete"),
        F.max(F.coalesce(F.col("amount") >= high_amount, F.lit(False))).alias("_high"),
        F.min(F.struct("date", "amount", "vendor", "vendor_id")).alias("r"),
    )
    matched = pairs.select(F.col("source_1_id").alias("txn_id")).distinct().withColumn("_matched", F.lit(True))
    return per_txn.join(matched, "txn_id", "left").select(
        "txn_id",
        "r.*",
        "rows",
        (F.col("_matched").isNull() | F.col("_high")).alias("is_unmatched"),
        "is_incomplete",
        (F.col("rows") > 1).alias("is_duplicate"),
    )


def flags_of(
    per_txn: DataFrame,
    audit_run_id: str,
    created_at: str,
    whitelist: DataFrame | None = None,
    severity: SeverityParams = SeverityParams(),
    escalation_mode: str = "live",
) -> DataFrame:
    """Flags of the findings, one per transaction id at most; each id is judged by itself."""
    final = escalation_rules(severity_live(per_txn, severity), whitelist, escalation_mode, auto_approve_below=severity.auto_approve_below)
    return create_flags(explain(final), audit_run_id, created_at)


def run_audit(
    cards: DataFrame,
    bank: DataFrame,
    audit_run_id: str,
    created_at: str,
    whitelist: DataFrame | None = None,
    match: MatchParams = MatchParams(),
    severity: SeverityParams = SeverityParams(),
    completeness_threshold: float = 0.90,
    halt_on_gate: bool = False,
    escalation_mode: str = "live",
) -> AuditResult:
    """Audit ``cards`` against ``bank`` (both gold). Nothing is written; pass the frames to the sinks."""
    quality = quality_gate(completeness(cards), completeness_threshold, halt=halt_on_gate)
    if halt_on_gate:
        quality.select("gate_passed").first()
    pairs = match_one_to_one(cards, bank, match)
    per_txn = transaction_findings(cards, pairs, severity.high_amount)
    flags = flags_of(per_txn, audit_run_id, created_at, whitelist, severity, escalation_mode)
    suspect = F.col("is_unmatched") | F.col("is_incomplete") | F.col("is_duplicate")
    rows = per_txn.agg(F.coalesce(F.sum(F.when(suspect, F.col("rows"))), F.lit(0)).alias("n"))
    return AuditResult(flags, pairs, per_txn, quality, audit_summary(audit_run_id, cards, flags, rows))


@dataclass(frozen=True)
class FullAudit:
    """``findings``: one row per suspicious transaction id with everything that speaks for or against it. ``trail``: one row for each step of the
    run, numbered. ``state``: the run's last state."""

    flags: DataFrame
    findings: DataFrame
    pairs: DataFrame
    anomalies: DataFrame
    late: DataFrame
    quality: DataFrame
    summary: DataFrame
    trail: DataFrame
    state: DataFrame


def learned(rules: DataFrame, cards: DataFrame, p: AnomalyParams) -> tuple[DataFrame, AnomalyParams]:
    """What a rule set (rule, value, as feedback leaves it) means for a run: vendors that are whitelisted by their id, and the
    widened sigmas. Only the few sigma rules reach the driver; the whitelist stays a table."""
    listed = rules.where(F.startswith("rule", F.lit("whitelist:")) & (F.col("value") == "true")).select(F.expr("substring(rule, 11)").alias("vendor_id"))
    vendors = cards.join(listed.distinct(), "vendor_id", "left_semi").where("vendor IS NOT NULL").select("vendor").distinct()
    names = {"amount_outlier.sigma": "amount_sigma", "vendor_outlier.sigma": "profile_sigma"}
    found = {names[r.rule]: float(r.value) for r in rules.where(F.col("rule").isin(*names)).collect()}
    return vendors, replace(p, **found)


def full_audit(
    cards: DataFrame,
    bank: DataFrame,
    emails: DataFrame,
    events: DataFrame,
    receipts_ocr: DataFrame,
    audit_run_id: str,
    created_at: str,
    rules: DataFrame | None = None,
    match: MatchParams = MatchParams(),
    anomaly: AnomalyParams = AnomalyParams(),
    severity: SeverityParams = FULL_SEVERITY,
    include_forest: bool = False,
    completeness_threshold: float = 0.90,
) -> FullAudit:
    """Quality, reconciliation, anomalies, context of what is suspicious, severity, escalation and flags, with trail and state.

    Suspicious are ids without a match, incomplete or repeated ones, and those with any anomaly. Context is looked up for them only.
    Flags are made from the information cut on. ``rules`` are learned rules: their whitelist and sigmas apply.
    """
    whitelist, anomaly = learned(rules, cards, anomaly) if rules is not None else (None, anomaly)
    quality = quality_gate(completeness(cards), completeness_threshold, halt=False)
    pairs = match_one_to_one(cards, bank, match)
    matched = pairs.select(F.col("source_1_id").alias("txn_id")).distinct().withColumn("matched", F.lit(True))
    forest = isolation_forest_fit_score(anomaly_features(cards))[1] if include_forest else None
    anomalies = cut(anomaly_report(cards, build_vendor_profiles(cards), forest, anomaly).select("txn_id", "anomaly_score", "reasons"))
    late = late_payments(cards, anomaly.late_days)
    judged = (
        transaction_findings(cards, pairs, severity.high_amount)
        .join(matched, "txn_id", "left")
        .join(anomalies, "txn_id", "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
        .withColumn("payment_day", F.to_date("date"))
        .join(late.select("vendor_id", "payment_day", "days_late"), ["vendor_id", "payment_day"], "left")
        .drop("payment_day")
    )
    suspicious = cut(judged.where("NOT matched OR is_incomplete OR is_duplicate OR anomaly_score > 0"))
    context = enriched_transactions(suspicious.select("txn_id", "vendor", "amount", "date"), emails, events, receipts_ocr)
    findings = cut(severity_full(suspicious.join(context.drop("confidence"), "txn_id"), severity, anomaly.high_risk))
    scored = findings.where(~F.col("below_info") & (F.size("factors") > 0))
    final = escalation_rules(scored, whitelist, "live", auto_approve_below=severity.auto_approve_below)
    flags = cut(create_flags(explain(final), audit_run_id, created_at))
    rows = findings.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    summary = audit_summary(audit_run_id, cards, flags, rows)
    trail = _trail(audit_run_id, created_at, cards, quality, pairs, anomalies, findings, flags)
    state = summary.select(
        "audit_run_id", F.lit("completed").alias("workflow_status"), F.lit("Logging").alias("current_agent"),
        F.to_json(F.struct("transactions_processed", "flags_created")).alias("intermediate_results"),
        F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(created_at).cast("timestamp").alias("updated_at"),
    )
    return FullAudit(flags, findings, pairs, anomalies, late, quality, summary, trail, state)


def _trail(run: str, at: str, cards: DataFrame, quality: DataFrame, pairs: DataFrame, anomalies: DataFrame, findings: DataFrame, flags: DataFrame) -> DataFrame:
    """One numbered row for each step, with what it found. The times are those of the run, a second apart, so that a retry writes the same."""

    def step(no: int, agent: str, tool: str, df: DataFrame, text) -> DataFrame:
        return df.agg(text.alias("output_summary")).select(
            F.lit(run).alias("audit_run_id"), (F.lit(at).cast("timestamp") + F.make_dt_interval(secs=F.lit(no))).alias("timestamp"), F.lit(agent).alias("agent_name"),
            F.lit(tool).alias("tool_called"), F.lit(None).cast("long").alias("execution_time_ms"), F.lit(None).cast("string").alias("input_data"), "output_summary",
        )

    def counted(what: str):
        return F.concat(F.count("*").cast("string"), F.lit(f" {what}"))

    steps = [
        step(1, "DataQuality", "completeness", quality, F.concat(F.lit("completeness "), F.first("completeness_score").cast("string"))),
        step(2, "Reconciliation", "match_one_to_one", pairs, counted("pairs")),
        step(3, "AnomalyDetection", "anomaly_report", anomalies.where("anomaly_score > 0"), counted("anomalous ids")),
        step(4, "ContextEnrichment", "enriched_transactions", findings, counted("suspicious ids")),
        step(5, "Escalation", "severity_full", flags, counted("flags")),
        step(6, "Logging", "write_audit_trail", cards, counted("rows audited")),
    ]
    return decision_log(reduce(DataFrame.unionByName, steps))
