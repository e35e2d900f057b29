"""Completeness, schema conformity, duplicates, freshness, row rules and the quality gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import labels_where, missing
from ..functions.skew import join_unique
from ..params import AUDIT_STATUSES, REQUIRED_FIELDS, SEVERITIES, SOURCES
from .filters import incomplete_rows

# The type names a schema expectation may use, the Spark types that satisfy them, and the type
# that values are tried against.
TYPE_NAMES = {
    "float": ({"double", "float"}, "double"),
    "int": ({"integer", "long"}, "bigint"),
    "str": ({"string"}, "string"),
    "datetime": ({"timestamp", "timestamp_ntz", "date"}, "timestamp"),
}


def _completeness_aggs(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    total = F.count("*")
    out = [total.alias("total_records")]
    missing_cells = F.lit(0)
    for f in fields:
        # an absent column counts as missing in every row
        n = F.count_if(missing(df, f)) if f in df.columns else total
        out.append(n.alias(f"missing_{f}"))
        missing_cells = missing_cells + n
    ratio = F.try_divide(missing_cells, total * len(fields))
    out.append(F.coalesce(F.round(1 - ratio, 3), F.lit(0.0)).alias("completeness_score"))
    return out


def completeness(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Missing values per required field and the share of filled cells, in one pass."""
    return df.agg(*_completeness_aggs(df, fields))


def completeness_by(df: DataFrame, keys: Sequence[str], fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    return df.groupBy(*keys).agg(*_completeness_aggs(df, fields))


def schema_violations(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Missing fields, wrong declared types, and how many values of a field do not cast to its type."""
    spark = df.sparkSession
    facts, casts = [], []
    for field, name in expected.items():
        if field not in df.columns:
            facts.append((field, "Missing field", f"Field {field} not found in table"))
        elif name in TYPE_NAMES:
            fits, target = TYPE_NAMES[name]
            actual = df.schema[field].dataType.typeName()
            if actual not in fits:
                facts.append((field, "Type mismatch", f"Expected {name}, got {actual}"))
                bad = F.col(field).isNotNull() & F.col(field).cast("string").try_cast(target).isNull()
                casts.append((field, F.count_if(bad)))
    schema = "field string, error string, details string"
    declared = spark.createDataFrame(facts, schema)
    counts = df.agg(F.count("*").alias("_rows"), *[c.alias(f"_bad_{f}") for f, c in casts])
    # an empty table has no violations
    filled = F.coalesce(counts.select("_rows").scalar(), F.lit(0)) > 0
    if not casts:
        return declared.filter(filled).withColumn("bad_values", F.lit(0).cast("bigint"))
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"_bad_{f}").alias("bad_values")) for f, _ in casts]
    per_field = counts.select(F.inline(F.array(*pairs)))  # one row per expected field
    joined = declared.join(F.broadcast(per_field), "field", "left").filter(filled)
    return joined.select("field", "error", "details", F.coalesce("bad_values", F.lit(0)).alias("bad_values"))


def _key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once; NULL keys count as equal. Absent key column: no rows."""
    if any(k not in df.columns for k in keys):
        return df.limit(0)
    # NULL must equal NULL, so join on the value (or a default) plus a null marker
    names = [f"_k{i}" for i in range(2 * len(keys))]
    marked = df
    for i, k in enumerate(keys):
        text = F.col(k).cast("string")
        marked = marked.withColumns({names[2 * i]: F.coalesce(text, F.lit("")), names[2 * i + 1]: text.isNull()})
    counts = _key_counts(marked, names)
    repeated = counts.filter("n > 1").select(*names)
    return join_unique(marked, repeated, names, "left_semi", counts=counts).select(*df.columns)


def duplicate_groups(
    df: DataFrame, keys: Sequence[str], id_col: str = "txn_id", max_ids: int | None = None, ids_per_row: int = 10_000
) -> DataFrame:
    """Repeated keys without NULLs: key, count and all ids in order. A key with more than about ``ids_per_row`` rows has several
    rows that share its ids out, so that no list outgrows a task. ``max_ids``: only the first ids, for display."""
    if any(k not in df.columns for k in keys):
        return df.limit(0).select(F.lit(0).cast("bigint").alias("count"), F.array().cast("array<string>").alias("ids"))
    whole = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    groups = _key_counts(whole, keys).filter("n > 1")
    if max_ids is not None:
        # the rank filter is applied before the shuffle too, so a hot key ships at most max_ids rows per task
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))
        first = whole.select(*keys, F.col(id_col).alias("_id")).withColumn("_rank", rank).filter(F.col("_rank") <= max_ids)
        ids = first.groupBy(*keys).agg(F.array_sort(F.collect_list("_id")).alias("ids"))
        return groups.join(ids, list(keys)).select(*keys, F.col("n").alias("count"), "ids")
    rows = whole.select(*keys, F.col(id_col).alias("_id")).join(groups, list(keys))
    shares = F.ceil(F.col("n") / F.lit(ids_per_row))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64("_id"), shares))
    return dealt.groupBy(*keys, "n", "_share").agg(F.array_sort(F.collect_list("_id")).alias("ids")).select(*keys, F.col("n").alias("count"), "ids")


def freshness_config(
    domains: DataFrame, config: DataFrame, default_hours: int = 48, default_critical: float = 1000.0
) -> DataFrame:
    """Each row of ``domains`` with its freshness settings.

    ``config`` (domain, max_age_hours, critical_amount_threshold) is a rule table; unknown domains take its
    ``default`` row; without one, 48 hours at confidence 0.5.
    """
    fallback = config.filter(F.col("domain") == "default").limit(1)
    base_hours = fallback.select("max_age_hours").scalar()
    base_critical = fallback.select("critical_amount_threshold").scalar()
    named = config.filter(F.col("domain").isNotNull()).select(
        "domain",
        F.col("max_age_hours").alias("_h"),
        F.col("critical_amount_threshold").alias("_c"),
        F.lit(True).alias("_named"),
    )
    known = F.col("_named").isNotNull() | base_hours.isNotNull()
    hours = F.when(F.col("_named"), F.coalesce("_h", F.lit(default_hours))).otherwise(
        F.coalesce(base_hours, F.lit(default_hours))
    )
    critical = F.when(F.col("_named"), F.coalesce("_c", F.lit(default_critical))).otherwise(
        F.coalesce(base_critical, F.lit(default_critical))
    )
    return (
        join_unique(domains, named, ["domain"])
        .withColumns(
            {
                "max_age_hours": hours.cast("int"),
                "critical_amount_threshold": critical.cast("double"),
                "confidence": F.when(known, F.lit(1.0)).otherwise(F.lit(0.5)),
                "config_source": F.when(known, F.lit("manual_config")).otherwise(F.lit("fallback")),
            }
        )
        .drop("_h", "_c", "_named")
    )


def freshness_violations(txns: DataFrame, config: DataFrame, as_of: str) -> DataFrame:
    """Transactions older at ``as_of`` than their domain allows."""
    now = F.lit(as_of).cast("timestamp")
    aged = freshness_config(txns, config).withColumn(
        "age_hours", F.floor((F.unix_micros(now) - F.unix_micros("date")) / F.lit(3_600_000_000))
    )
    limit = F.unix_micros("date") + F.col("max_age_hours") * F.lit(3_600_000_000).cast("bigint")
    return aged.filter(F.unix_micros(now) > limit)


# rule name -> SQL condition that is true when the row breaks the rule
TRANSACTION_RULES = {
    "txn_id_required": "txn_id is null",
    "amount_positive": "not coalesce(amount > 0 and not isnan(amount), false)",
    "vendor_required": "vendor is null",
    "date_required": "date is null",
    "source_known": f"not coalesce(source in {SOURCES}, false)",
}
FLAG_RULES = {
    "severity_known": f"not coalesce(severity_level in {SEVERITIES}, false)",
    "confidence_in_range": "confidence_score is not null and not confidence_score between 0 and 1",
    "flag_id_required": "flag_id is null",
    "transaction_id_required": "transaction_id is null",
}
STATE_RULES = {"status_known": f"not coalesce(workflow_status in {AUDIT_STATUSES}, false)"}


def row_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``violations``: the names of the rules the row breaks. Rules are SQL conditions."""
    return df.withColumn("violations", labels_where([(F.expr(sql), name) for name, sql in rules.items()]))


def quality_gate(metrics: DataFrame, threshold: float = 0.90, halt: bool = False) -> DataFrame:
    """Adds ``gate_passed``; a missing score counts as 0. ``halt`` makes a failed gate an error."""
    score = (
        F.coalesce(F.col("completeness_score"), F.lit(0.0))
        if "completeness_score" in metrics.columns
        else F.lit(0.0)
    )
    passed = score >= F.lit(threshold)
    if halt:
        passed = F.when(passed, F.lit(True)).otherwise(
            F.raise_error(F.lit("quality gate failed")).cast("boolean")
        )
    return metrics.withColumn("gate_passed", passed)


def quality_report(
    txns: DataFrame,
    config: DataFrame,
    as_of: str,
    expected: dict[str, str],
    keys: Sequence[str] = ("txn_id",),
    threshold: float = 0.90,
) -> DataFrame:
    """One row of totals for a table; the row-level findings come from the single operators."""
    gate = quality_gate(completeness(txns), threshold)
    counts = {
        "incomplete_records": incomplete_rows(txns).agg(F.count("*")),
        "schema_violations": schema_violations(txns, expected).agg(F.count("*")),
        "duplicate_rows": _key_counts(txns, keys).agg(
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
        ),
        "freshness_violations": freshness_violations(txns, config, as_of).agg(F.count("*")),
    }
    return gate.select("*", *[c.scalar().alias(name) for name, c in counts.items()])
