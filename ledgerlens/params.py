"""Every weight and threshold of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# They decide results and must stay as they are.
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
AUDIT_STATUSES = ("pending", "in_progress", "completed", "failed", "paused")
HUMAN_DECISIONS = ("approved", "rejected", "false_positive", "needs_more_info")
SOURCES = ("credit_card", "bank", "email", "receipt", "vendor_invoice")
REQUIRED_FIELDS = ("vendor", "amount", "date", "source")
LIVE_REQUIRED_FIELDS = ("vendor", "amount", "date")
APPROVAL_KEYWORDS = (
    "approved",
    "authorize",
    "authorized",
    "go ahead",
    "proceed",
    "looks good",
    "lgtm",
    "approved for payment",
    "please pay",
)
EXPLANATIONS = {
    "no_reconciliation_match": "No matching bank transaction found for ${amount} to {vendor}",
    "incomplete_data": "Transaction {txn_id} is missing required fields",
    "duplicate_transaction": "Transaction {txn_id} appears to be a duplicate",
    "high_amount": "Transaction amount ${amount} exceeds high-value threshold",
    "high_anomaly_score": "Transaction amount ${amount} is statistically unusual for this vendor",
    "no_email_approval": "No email approval or authorization found",
    "no_receipt": "Receipt not found in system",
}
FALLBACK_EXPLANATION = "Transaction flagged due to multiple suspicious indicators."
# Price in dollars per million tokens is an input of cost_report; there is no built-in price list.


@dataclass(frozen=True)
class MatchParams:
    """Tolerances of card/bank matching."""

    amount_pct: float = 0.05
    max_days: int = 3
    sign_insensitive: bool = False
    exact_confidence: float = 0.95
    near_confidence: float = 0.85


@dataclass(frozen=True)
class ReceiptParams:
    amount_pct: float = 0.05
    max_days: int = 7
    w_amount: float = 0.4
    w_date: float = 0.3
    w_vendor: float = 0.3


@dataclass(frozen=True)
class SeverityParams:
    """Weights per factor and the cuts between levels; the default is what a live run uses."""

    weights: dict[str, int] = field(
        default_factory=lambda: {
            "no_reconciliation_match": 50,
            "incomplete_data": 30,
            "duplicate_transaction": 40,
            "high_amount": 20,
        }
    )
    critical: int = 70
    warning: int = 50
    info: int = 0
    high_amount: float = 5000.0
    auto_approve_below: float = 50.0


TOOL_SEVERITY = SeverityParams(
    weights={"no_reconciliation_match": 50, "incomplete_data": 30, "high_amount": 20}, high_amount=10000.0
)
FULL_SEVERITY = SeverityParams(
    weights={
        "no_reconciliation_match": 40,
        "high_anomaly_score": 30,
        "no_email_approval": 20,
        "no_receipt": 10,
    },
    critical=80,
    warning=50,
    info=20,
)


@dataclass(frozen=True)
class AnomalyParams:
    forest_points: int = 30
    vendor_points: int = 30
    amount_points: int = 20
    series_points: int = 20
    high_risk: int = 70
    profile_sigma: float = 3.0
    amount_sigma: float = 2.0
    vendor_sigma: float = 2.5
    min_transactions: int = 5
    rolling_window: int = 3
    deviation_pct: float = 20.0
    late_days: int = 5


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    op: str
    threshold: float


ALERT_RULES = (
    AlertRule("AuditTimeout", "audit_completion_time_seconds", ">", 1800.0),
    AlertRule("AgentFailureSpike", "agent_success_rate", "<", 0.90),
    AlertRule("LLMCostSpike", "llm_cost_dollars_per_hour", ">", 5.0),
    AlertRule("DataQualityDegradation", "data_completeness_score", "<", 0.85),
    AlertRule("FalsePositiveRateHigh", "false_positive_rate", ">", 0.20),
)
DURATION_BUCKETS = {
    "audit": (30, 60, 120, 300, 600, 1800),
    "step": (5, 15, 30, 60, 120, 300),
    "review": (30, 60, 180, 300, 600),
    "trail_write": (0.01, 0.05, 0.1, 0.5, 1),
}
