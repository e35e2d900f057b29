"""Reviewer decisions and what the rules learn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_unique


def apply_reviews(flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flags with their last review. ``reviews``: flag_id, human_decision, reviewer_id, review_timestamp,
    reviewer_notes. Ties in time go to the larger decision, reviewer and notes."""
    last = reviews.groupBy("flag_id").agg(
        F.max(F.struct("review_timestamp", "human_decision", "reviewer_id", "reviewer_notes")).alias("r")
    )
    new = {
        c: F.coalesce(F.col(f"r.{c}"), F.col(c) if c in flags.columns else F.lit(None))
        for c in ("human_decision", "reviewer_id", "review_timestamp", "reviewer_notes")
    }
    before = F.coalesce(F.col("reviewed"), F.lit(False)) if "reviewed" in flags.columns else F.lit(False)
    joined = flags.join(last, "flag_id", "left")
    return joined.withColumns({**new, "reviewed": F.col("r").isNotNull() | before}).drop("r")


def _false_positive():
    return F.coalesce(F.col("reviewed") & (F.col("human_decision") == "false_positive"), F.lit(False))


def _recent(flags: DataFrame, as_of: str, days: int) -> DataFrame:
    start = F.to_date(F.lit(as_of).cast("timestamp")) - F.expr(f"interval {days} days")
    return flags.filter(F.col("created_at") > start.cast("timestamp"))


def _rates(flags: DataFrame, keys: list[str]) -> DataFrame:
    counted = flags.groupBy(*keys).agg(F.count_if(_false_positive()).alias("false_positives"), F.count("*").alias("flags"))
    rated = counted.withColumn("fp_rate", F.try_divide(F.col("false_positives"), F.col("flags")))
    return rated.filter("false_positives > 0")


def flags_with_vendor(flags: DataFrame, txns: DataFrame) -> DataFrame:
    """Flags with vendor_id, vendor and amount of their transaction (the flags table has none of them)."""
    first = txns.groupBy(F.col("txn_id").alias("transaction_id")).agg(
        F.min(F.struct("date", "vendor_id", "vendor", "amount")).alias("t")
    )
    return flags.join(first, "transaction_id", "left").select(
        flags["*"], F.col("t.vendor_id").alias("vendor_id"), F.col("t.vendor").alias("vendor"), F.col("t.amount").alias("amount")
    )


def fp_rate_by_vendor(flags: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """False positives over all flags per vendor in the last ``days``; vendors without one have no row."""
    recent = _recent(flags, as_of, days).filter("vendor_id is not null")
    named = recent.groupBy("vendor_id").agg(F.min("vendor").alias("vendor"))
    return _rates(recent, ["vendor_id"]).join(named, "vendor_id").select(
        "vendor_id", "vendor", "false_positives", "flags", "fp_rate"
    )


def vendors_to_whitelist(rates: DataFrame, whitelist: DataFrame, above: float = 0.80) -> DataFrame:
    """Vendors above the rate that are not on the whitelist (vendor_id) yet; carries id and name."""
    listed = whitelist.filter("vendor_id is not null").select("vendor_id").distinct()
    return rates.filter(F.col("fp_rate") > above).join(listed, "vendor_id", "left_anti").select("vendor_id", "vendor", "fp_rate")


def fp_rate_by_rule(flags: DataFrame, as_of: str, days: int = 7, by: str = "factors") -> DataFrame:
    """The same per rule: every contributing factor of a flag, or its whole explanation text."""
    recent = _recent(flags, as_of, days)
    if by == "factors":
        ruled = recent.select("reviewed", "human_decision", F.explode("factors").alias("rule"))
    else:
        ruled = recent.select("reviewed", "human_decision", F.col("explanation").alias("rule")).filter("rule is not null")
    return _rates(ruled, ["rule"])


def sigma_adjustments(
    rule_rates: DataFrame, sigma: float, above: float = 0.50, step: float = 0.5, rule: str = "amount_outlier"
) -> DataFrame:
    """One row: every matching rule above the rate widens sigma by one step."""
    hits = rule_rates.agg(
        F.count_if((F.col("fp_rate") > above) & F.contains(F.col("rule"), F.lit(rule))).alias("matching_rules")
    )
    return hits.select(
        F.lit(rule).alias("rule"),
        F.lit(sigma).alias("old_sigma"),
        "matching_rules",
        (F.lit(sigma) + F.col("matching_rules") * F.lit(step)).alias("new_sigma"),
    )


def rule_changes(whitelisted: DataFrame, sigma: DataFrame, changed_at: str) -> DataFrame:
    """Change log rows (append them): action, rule, old and new value, reason, time."""
    at = F.lit(changed_at).cast("timestamp").alias("changed_at")
    added = whitelisted.select(
        F.lit("whitelist_vendor").alias("action"),
        F.concat(F.lit("whitelist:"), F.col("vendor_id")).alias("rule"),
        F.lit(None).cast("string").alias("old_value"),
        F.lit("true").alias("new_value"),
        F.format_string("FP rate: %.2f%%", F.col("fp_rate") * 100).alias("reason"),
        at,
    )
    moved = sigma.filter("new_sigma <> old_sigma").select(
        F.lit("adjust_threshold").alias("action"),
        F.concat(F.col("rule"), F.lit(".sigma")).alias("rule"),
        F.format_string("%.1f", F.col("old_sigma")).alias("old_value"),
        F.format_string("%.1f", F.col("new_sigma")).alias("new_value"),
        F.format_string("%d matching rules", F.col("matching_rules")).alias("reason"),
        at,
    )
    return added.unionByName(moved)


def current_rules(changes: DataFrame) -> DataFrame:
    """The rule set after all changes: the last value per rule."""
    return changes.groupBy("rule").agg(F.max(F.struct("changed_at", "new_value")).alias("c")).select(
        "rule", F.col("c.new_value").alias("value"), F.col("c.changed_at").alias("changed_at")
    )


def mark_entities_whitelisted(entities: DataFrame, whitelisted: DataFrame) -> DataFrame:
    """Entities with ``whitelisted``: true if decided now or before."""
    now = whitelisted.select(F.col("vendor_id").alias("entity_id"), F.lit(True).alias("_now")).distinct()
    before = F.col("whitelisted") if "whitelisted" in entities.columns else F.lit(None).cast("boolean")
    joined = join_unique(entities, now, ["entity_id"])
    return joined.withColumn("whitelisted", F.coalesce("_now", before, F.lit(False))).drop("_now")
