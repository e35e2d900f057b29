"""Every operator as a query over the driver tables, next to the SQL that must give the same rows.

Results are made comparable: doubles are rounded, dates and arrays become text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    anomaly,
    context,
    corrupt,
    entities,
    escalate,
    evaluate,
    feedback,
    filters,
    iforest,
    matching,
    monitor,
    quality,
    receipts,
    reconcile,
    trail,
)
from ..params import APPROVAL_KEYWORDS, DURATION_BUCKETS, TOOL_SEVERITY, AnomalyParams, SeverityParams
from ..sources import catalog, gold, sinks
from . import audit, testbed as tb
from .testbed import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-11-10 00:00:00"
FLAGS_AS_OF = "2000-06-15 12:00:00"
TRAIL_AS_OF = "2024-01-30 00:00:00"


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def second(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def rounded(c: str, digits: int):
    """A mean can lie exactly between two rounded values, where the order of its sum decides; the small shift
    (the same in the SQL) sends both sides the same way."""
    return F.round(F.col(c) + F.lit(1e-9), digits).alias(c)


def joined(c: str):
    return F.array_join(c, ",").alias(c)


# ---- sources and slices ------------------------------------------------------------------------------

GOLD_SQL = "select txn_id, source, amount, vendor, vendor_id, strftime(date, '%Y-%m-%d') as date from "


@query(
    "gold_cards",
    sql(
        "select expense_id as txn_id, 'credit_card' as source, amount, merchant as vendor, "
        "cast(null as varchar) as vendor_id, strftime(expense_date, '%Y-%m-%d') as date, category, card_last4 "
        "from card_expenses",
        "card_expenses",
    ),
)
def gold_cards(spark, root):
    out = gold.to_gold(tb.card_expenses(spark, root), "credit_card")
    return out.select("txn_id", "source", "amount", "vendor", "vendor_id", day("date"), "category", "card_last4")


@query(
    "synth_bank_ids",
    sql(
        "select 'BANK_' || lpad(cast(n as varchar), greatest(6, length(cast(n as varchar)))::int, '0') as txn_id, "
        "strftime(transaction_date, '%Y-%m-%d') as transaction_date, description, amount, bank_account_id from "
        "(select *, row_number() over (order by transaction_date, description, amount, running_balance, "
        "bank_account_id, type) as n from (select * replace (round(amount, 2) as amount) from bank_raw where amount is not null))",
        "bank_raw",
    ),
)
def synth_bank_ids(spark, root):
    raw = tb.bank_raw(spark, root).withColumn("amount", F.round("amount", 2)).filter("amount is not null")
    return gold.synth_bank_ids(raw).select(
        "txn_id", day("transaction_date"), "description", "amount", "bank_account_id"
    )


@query(
    "gold_union",
    sql(
        "select source, count(*) as n, count(vendor) as vendors, round(sum(cast(round(amount * 100) as bigint)) / 100.0, 2) as total "
        "from (select source, vendor, amount from cards union all select source, vendor, amount from bank "
        "union all select source, vendor, amount from receipts) group by source",
        "cards",
        "bank",
        "receipts",
    ),
)
def gold_union(spark, root):
    out = gold.gold_union(tb.cards(spark, root), tb.bank(spark, root), tb.receipts(spark, root))
    cents = F.sum(F.round(F.col("amount") * 100).cast("long"))
    return out.groupBy("source").agg(
        F.count("*").alias("n"), F.count("vendor").alias("vendors"), F.round(cents / 100.0, 2).alias("total")
    )


@query(
    "transactions_for_audit",
    sql(
        "select expense_id as txn_id, amount, merchant as vendor, strftime(expense_date, '%Y-%m-%d') as date, category "
        "from card_expenses where expense_date >= date '1998-01-01'",
        "card_expenses",
    ),
)
def transactions_for_audit(spark, root):
    out = gold.transactions_for_audit(tb.card_expenses(spark, root), "1998-01-01")
    return out.select("txn_id", "amount", "vendor", day("date"), "category")


@query(
    "bank_in_range",
    sql(
        GOLD_SQL + "bank where date >= timestamp '1997-01-01' and date <= timestamp '1997-12-31'",
        "bank",
    ),
)
def bank_in_range(spark, root):
    out = gold.in_range(tb.bank(spark, root), "date", "1997-01-01", "1997-12-31")
    return out.select("txn_id", "source", "amount", "vendor", "vendor_id", day("date"))


@query(
    "last_audit_timestamp",
    sql(
        "select strftime(coalesce(max(created_at) filter (workflow_status = 'completed'), timestamp '2025-01-01'), "
        "'%Y-%m-%d %H:%M:%S') as last_audit_timestamp from workflow_state",
        "workflow_state",
    ),
)
def last_audit_timestamp(spark, root):
    return gold.last_audit_timestamp(tb.workflow_state(spark, root)).select(second("last_audit_timestamp"))


@query(
    "new_transactions",
    sql(
        "select txn_id, amount, strftime(date, '%Y-%m-%d') as date from cards where date > timestamp '2001-01-01'",
        "cards",
    ),
)
def new_transactions(spark, root):
    out = gold.new_transactions(tb.cards(spark, root), "2001-01-01", created_col="date")
    return out.select("txn_id", "amount", day("date"))


@query(
    "audit_sql",
    sql(
        "select vendor, count(*) as n, round(max(amount), 2) as top from cards where source = 'credit_card' "
        "and date between timestamp '1996-01-01' and timestamp '1999-12-31' group by vendor",
        "cards",
    ),
)
def audit_sql(spark, root):
    catalog.register_tables(spark, {"gold.transactions": tb.cards(spark, root)})
    return catalog.audit_sql(
        spark,
        "select vendor, count(*) as n, round(max(amount), 2) as top from gold_transactions "
        "where source = 'credit_card' and date between timestamp'1996-01-01' and timestamp'1999-12-31' group by vendor",
    )


@query(
    "source_date_slice",
    sql(
        "select txn_id, amount, strftime(date, '%Y-%m-%d') as date from bank where source = 'bank' "
        "and date between timestamp '1996-03-01' and timestamp '1996-09-30'",
        "bank",
    ),
)
def source_date_slice(spark, root):
    out = filters.source_date_slice(tb.bank(spark, root), "bank", "1996-03-01", "1996-09-30")
    return out.select("txn_id", "amount", day("date"))


@query(
    "incomplete_rows",
    sql("select txn_id, amount, vendor from cards where vendor is null or amount is null or date is null", "cards"),
)
def incomplete_rows(spark, root):
    return filters.incomplete_rows(tb.cards(spark, root)).select("txn_id", "amount", "vendor")


UNMATCHED_SQL = (
    "select txn_id from cards c where not exists (select 1 from bank b where b.vendor_id = c.vendor_id and b.date = c.date)"
)


def _no_same_day_partner(spark, root):
    bank = tb.bank(spark, root).select("vendor_id", "date").distinct()
    return tb.cards(spark, root).join(bank, ["vendor_id", "date"], "left_anti").select("txn_id")


@query(
    "high_value_unreconciled",
    sql(
        "select txn_id, amount from cards where amount >= 4800 and txn_id not in (" + UNMATCHED_SQL + ")", "cards", "bank"
    ),
)
def high_value_unreconciled(spark, root):
    out = filters.high_value_unreconciled(tb.cards(spark, root), _no_same_day_partner(spark, root), 4800.0)
    return out.select("txn_id", "amount")


@query(
    "suspicious_transactions",
    sql(
        "select txn_id, amount, vendor from cards_rep where txn_id in (select txn_id from cards_rep where vendor is null "
        "or amount is null or date is null) or txn_id in (select txn_id from cards_rep group by txn_id having count(*) > 1) "
        "or txn_id in (select txn_id from cards_rep where amount >= 5000)",
        "cards_rep",
    ),
)
def suspicious_transactions(spark, root):
    cards = tb.cards(spark, root, repeated_ids=True)
    large = cards.filter("amount >= 5000").select("txn_id")
    out = filters.suspicious_transactions(
        cards, large, filters.incomplete_rows(cards), quality.duplicate_rows(cards, ["txn_id"])
    )
    return out.select("txn_id", "amount", "vendor")


@query(
    "first_per_txn",
    sql(
        "select txn_id, strftime(date, '%Y-%m-%d') as date, amount, vendor_id from (select *, row_number() over "
        "(partition by txn_id order by date nulls first, amount nulls first, vendor_id) as r from cards_rep) where r = 1",
        "cards_rep",
    ),
)
def first_per_txn(spark, root):
    out = filters.first_per_txn(tb.cards(spark, root, repeated_ids=True), ["date", "amount", "vendor_id"])
    return out.select("txn_id", day("date"), "amount", "vendor_id")


@query(
    "cap_per_result",
    sql(
        "select vendor, txn_id, amount from (select *, row_number() over (partition by vendor order by amount desc "
        "nulls last, txn_id) as r from cards) where r <= 5",
        "cards",
    ),
)
def cap_per_result(spark, root):
    cards = tb.cards(spark, root).select("vendor", "txn_id", "amount")
    return filters.cap_per_result(cards, 5, [F.desc_nulls_last("amount"), "txn_id"], by=["vendor"])


# ---- quality -----------------------------------------------------------------------------------------

_COMPLETE = (
    "count(*) as total_records, count(*) - count(vendor) as missing_vendor, count(*) - count(amount) as missing_amount, "
    "count(*) - count(date) as missing_date, count(*) - count(source) as missing_source, "
    "round(1 - (4 * count(*) - count(vendor) - count(amount) - count(date) - count(source)) / (4.0 * count(*)), 3) "
    "as completeness_score"
)


@query("completeness", sql(f"select {_COMPLETE} from cards", "cards"))
def completeness(spark, root):
    return quality.completeness(tb.cards(spark, root))


@query("completeness_by", sql(f"select vendor_id, {_COMPLETE} from cards group by vendor_id", "cards"))
def completeness_by(spark, root):
    return quality.completeness_by(tb.cards(spark, root), ["vendor_id"])


@query(
    "schema_violations",
    sql(
        "select 'owner' as field, 'Missing field' as error, 'Field owner not found in table' as details, 0 as bad_values "
        "union all select 'vendor_id', 'Type mismatch', 'Expected datetime, got string', "
        "count(*) filter (vendor_id is not null and not regexp_matches(vendor_id, '^[0-9]{4,6}$')) from cards "
        "union all select 'vendor', 'Type mismatch', 'Expected float, got string', "
        "count(*) filter (vendor is not null and try_cast(vendor as double) is null) from cards",
        "cards",
    ),
)
def schema_violations(spark, root):
    expected = {
        "amount": "float",
        "vendor": "float",
        "vendor_id": "datetime",
        "date": "datetime",
        "owner": "str",
        "source": "money",
    }
    return quality.schema_violations(tb.cards(spark, root), expected)


@query(
    "duplicate_rows",
    sql(
        "select txn_id, amount, vendor_id from (select *, count(*) over (partition by txn_id) as n from cards_rep) where n > 1",
        "cards_rep",
    ),
)
def duplicate_rows(spark, root):
    out = quality.duplicate_rows(tb.cards(spark, root, repeated_ids=True), ["txn_id"])
    return out.select("txn_id", "amount", "vendor_id")


@query(
    "duplicate_rows_null_keys",
    sql(
        "select txn_id, vendor, strftime(date, '%Y-%m-%d') as date from "
        "(select *, count(*) over (partition by vendor, date) as n from cards) where n > 1",
        "cards",
    ),
)
def duplicate_rows_null_keys(spark, root):
    return quality.duplicate_rows(tb.cards(spark, root), ["vendor", "date"]).select("txn_id", "vendor", day("date"))


@query(
    "duplicate_groups",
    sql(
        "select vendor, strftime(date, '%Y-%m-%d') as date, count(*) as count, "
        "array_to_string(list_sort(list(txn_id)), ',') as ids from cards "
        "where vendor is not null and date is not null group by vendor, cards.date having count(*) > 1",
        "cards",
    ),
)
def duplicate_groups(spark, root):
    out = quality.duplicate_groups(tb.cards(spark, root), ["vendor", "date"])
    return out.select("vendor", day("date"), "count", joined("ids"))


def _domains(spark, root):
    nations = tb.table(spark, root, "supplier").selectExpr(
        "cast(s_suppkey as string) as vendor_id",
        "case when s_nationkey < 5 then 'inventory_management' when s_nationkey < 10 then 'senior_living' "
        "when s_nationkey < 20 then 'unlisted' end as domain",
    )
    return tb.cards(spark, root).join(nations, "vendor_id")


_DOMAIN_SQL = (
    "select c.*, case when s_nationkey < 5 then 'inventory_management' when s_nationkey < 10 then 'senior_living' "
    "when s_nationkey < 20 then 'unlisted' end as domain from cards c join supplier on vendor_id = cast(s_suppkey as varchar)"
)


def _domain_config(spark):
    return spark.createDataFrame(
        [("default", 48, 1000.0), ("inventory_management", 24, 5000.0), ("senior_living", 168, 10000.0)],
        "domain string, max_age_hours int, critical_amount_threshold double",
    )


@query(
    "freshness_config",
    sql(
        f"select txn_id, domain, case domain when 'inventory_management' then 24 when 'senior_living' then 168 else 48 end "
        "as max_age_hours, case domain when 'inventory_management' then 5000.0 when 'senior_living' then 10000.0 else 1000.0 end "
        f"::double as critical_amount_threshold, 1.0::double as confidence from ({_DOMAIN_SQL})",
        "cards",
    ),
)
def freshness_config(spark, root):
    out = quality.freshness_config(_domains(spark, root), _domain_config(spark))
    return out.select("txn_id", "domain", "max_age_hours", "critical_amount_threshold", "confidence")


@query(
    "freshness_violations",
    sql(
        f"select txn_id, domain from ({_DOMAIN_SQL}) where date + to_hours(case domain when 'inventory_management' then 24 "
        "when 'senior_living' then 168 else 48 end) < timestamp '2001-11-01 12:00:00'",
        "cards",
    ),
)
def freshness_violations(spark, root):
    out = quality.freshness_violations(_domains(spark, root), _domain_config(spark), "2001-11-01 12:00:00")
    return out.select("txn_id", "domain")


@query(
    "row_rules",
    sql(
        "select txn_id, concat_ws(',', case when not coalesce(amount > 0, false) then 'amount_positive' end, "
        "case when vendor is null then 'vendor_required' end, case when date is null then 'date_required' end) "
        "as violations from cards",
        "cards",
    ),
)
def row_rules(spark, root):
    out = quality.row_rules(tb.cards(spark, root), quality.TRANSACTION_RULES)
    return out.select("txn_id", joined("violations"))


@query(
    "quality_gate",
    sql(
        f"select vendor_id, completeness_score, completeness_score >= 0.97 as gate_passed from "
        f"(select vendor_id, {_COMPLETE} from cards group by vendor_id)",
        "cards",
    ),
)
def quality_gate(spark, root):
    scores = quality.completeness_by(tb.cards(spark, root), ["vendor_id"])
    return quality.quality_gate(scores, 0.97).select("vendor_id", "completeness_score", "gate_passed")


@query(
    "quality_report",
    sql(
        f"select *, completeness_score >= 0.90 as gate_passed from (select {_COMPLETE}, "
        "count(*) filter (vendor is null or amount is null or date is null) as incomplete_records, "
        "1 as schema_violations, "
        "(select coalesce(sum(n), 0)::bigint from (select count(*) as n from cards_rep group by txn_id having count(*) > 1)) "
        "as duplicate_rows, "
        "count(*) filter (date + to_hours(48) < timestamp '2001-11-01 12:00:00') as freshness_violations from cards_rep)",
        "cards_rep",
    ),
)
def quality_report(spark, root):
    cards = tb.cards(spark, root, repeated_ids=True).withColumn("domain", F.lit("default"))
    expected = {"amount": "float", "owner": "str"}
    return quality.quality_report(cards, _domain_config(spark), "2001-11-01 12:00:00", expected)


# ---- reconciliation ----------------------------------------------------------------------------------

_DAYS = "abs(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0))::bigint"
CANDIDATES_SQL = (
    "select c.txn_id as source_1_id, b.txn_id as source_2_id, c.amount as amount_1, b.amount as amount_2, "
    + _DAYS.format(a="c.date", b="b.date")
    + " as date_diff, c.date as date_1, b.date as date_2, coalesce('=' || c.vendor, '') as v1, c.vendor_id as k1, "
    "coalesce('=' || b.vendor, '') as v2, b.vendor_id as k2, c.vendor as vendor from cards c join bank b "
    "on (c.vendor = b.vendor or c.vendor_id = b.vendor_id) and abs(c.amount - b.amount) / abs(c.amount) <= 0.05 and "
    + _DAYS.format(a="c.date", b="b.date")
    + " <= 3"
)


@query(
    "match_candidates",
    sql(f"select source_1_id, source_2_id, amount_1, amount_2, date_diff from ({CANDIDATES_SQL})", "cards", "bank"),
)
def match_candidates(spark, root):
    return reconcile.match_candidates(tb.cards(spark, root), tb.bank(spark, root))


def _matching_oracle(rounds: int = 12) -> str:
    """Row by row, mutual first candidates, unrolled; the test suite compares with the serial loop."""
    parts = [
        f"e0 as materialized (select *, row_number() over (order by date_1, amount_1, v1, k1, source_1_id) as i, "
        f"row_number() over (order by date_2, amount_2, v2, k2, source_2_id) as j_raw from ({CANDIDATES_SQL}))",
        "ranks_i as materialized (select source_1_id, min(i) as ri from e0 group by 1)",
        "ranks_j as materialized (select source_2_id, min(j_raw) as rj from e0 group by 1)",
        "r0 as materialized (select e0.*, ri, rj from e0 join ranks_i using (source_1_id) join ranks_j using (source_2_id))",
    ]
    for k in range(rounds):
        parts.append(
            f"m{k} as materialized (select * from (select *, min(rj) over (partition by ri) as fj, "
            f"min(ri) over (partition by rj) as fi from r{k}) where rj = fj and ri = fi)"
        )
        parts.append(
            f"r{k + 1} as materialized (select * from r{k} where ri not in (select ri from m{k}) and rj not in (select rj from m{k}))"
        )
    columns = "source_1_id, source_2_id, amount_1, amount_2, date_diff, vendor"
    union = " union all ".join(f"select {columns} from m{k}" for k in range(rounds))
    return ", ".join(parts) + f", pairs as materialized ({union})"


@query(
    "match_one_to_one",
    sql(
        f"with {_matching_oracle()} select source_1_id, source_2_id, "
        "case when date_diff = 0 and amount_1 = amount_2 then 0.95 else 0.85 end::double as confidence, "
        "'amount_match=True, date_diff=' || date_diff as match_reason, amount_1 as amount, vendor from pairs",
        "cards",
        "bank",
    ),
)
def match_one_to_one(spark, root):
    return matching.match_one_to_one(tb.cards(spark, root), tb.bank(spark, root))


@query(
    "unmatched_transactions",
    sql(
        f"with {_matching_oracle()} select txn_id, source, amount from cards where txn_id not in (select source_1_id from pairs) "
        "union all select txn_id, source, amount from bank where txn_id not in (select source_2_id from pairs)",
        "cards",
        "bank",
    ),
)
def unmatched_transactions(spark, root):
    cards, bank = tb.cards(spark, root), tb.bank(spark, root)
    pairs = matching.match_one_to_one(cards, bank)
    columns = ["txn_id", "source", "amount"]
    return (
        reconcile.unmatched(cards, pairs, "source_1_id")
        .select(*columns)
        .unionByName(reconcile.unmatched(bank, pairs, "source_2_id").select(*columns))
    )


@query(
    "match_summary",
    sql(
        f"with {_matching_oracle()} select (select count(*) from pairs) as total_matched, "
        "(select count(*) from cards) - (select count(*) from pairs) as total_unmatched_1, "
        "(select count(*) from bank) - (select count(*) from pairs) as total_unmatched_2, "
        "round((select count(*) from pairs) / (select count(*) from cards)::double, 3) as match_rate",
        "cards",
        "bank",
    ),
)
def match_summary(spark, root):
    cards, bank = tb.cards(spark, root), tb.bank(spark, root)
    return reconcile.match_summary(cards, bank, matching.match_one_to_one(cards, bank))


@query(
    "low_confidence_matches",
    sql(
        f"with {_matching_oracle()} select source_1_id, source_2_id, 0.85::double as confidence from pairs "
        "where date_diff <> 0 or amount_1 <> amount_2",
        "cards",
        "bank",
    ),
)
def low_confidence_matches(spark, root):
    pairs = matching.match_one_to_one(tb.cards(spark, root), tb.bank(spark, root))
    return reconcile.low_confidence_matches(pairs, 0.9).select("source_1_id", "source_2_id", "confidence")


def _vendor_names(spark, root):
    """Supplier names as written on cards: canonical, alias, part of an alias, or unknown."""
    return tb.table(spark, root, "supplier").selectExpr(
        "case when s_suppkey % 4 = 0 then s_name when s_suppkey % 4 = 1 then 'SUP-' || s_suppkey "
        "when s_suppkey % 4 = 2 then s_name || ' INC' else 'New Vendor ' || s_suppkey end as vendor"
    )


_VENDOR_NAMES_SQL = (
    "select distinct case when s_suppkey % 4 = 0 then s_name when s_suppkey % 4 = 1 then 'SUP-' || s_suppkey "
    "when s_suppkey % 4 = 2 then s_name || ' INC' else 'New Vendor ' || s_suppkey end as vendor from supplier"
)


@query(
    "resolve_entities",
    sql(
        f"with names as ({_VENDOR_NAMES_SQL}), hits as (select vendor, min(entity_id) as entity_id from names join kg "
        "on vendor = canonical_name or list_contains(aliases, vendor) or contains(aliases[1], vendor) or contains(aliases[2], vendor) "
        "group by vendor) select vendor as vendor_name, coalesce(entity_id, 'unknown_' || lower(replace(vendor, ' ', '_'))) "
        "as canonical_entity_id, coalesce(canonical_name, vendor) as canonical_name, "
        "coalesce(array_to_string(aliases, ','), '') as aliases, case when entity_id is null then 0.0 else 0.95 end::double "
        "as confidence from names left join hits using (vendor) left join kg using (entity_id)",
        "kg",
    ),
)
def resolve_entities(spark, root):
    out = entities.resolve_entities(_vendor_names(spark, root), tb.kg_entities(spark, root))
    return out.select("vendor_name", "canonical_entity_id", "canonical_name", joined("aliases"), "confidence")


@query(
    "entities_of_type",
    sql("select entity_id, canonical_name from kg where entity_type = 'contractor'", "kg"),
)
def entities_of_type(spark, root):
    return entities.entities_of_type(tb.kg_entities(spark, root), "contractor").select("entity_id", "canonical_name")


def _name_pairs(spark, root):
    parts = tb.table(spark, root, "part")
    return parts.selectExpr("p_name as vendor_a", "concat(upper(p_name), ' ', lower(p_type)) as vendor_b")


@query("vendor_similarity")
def vendor_similarity(spark, root):
    return entities.vendor_similarity(_name_pairs(spark, root)).groupBy("vendor_a", "vendor_b", "similarity").count()


@query(
    "vendor_similarity_lev",
    "select p_name as vendor_a, upper(p_name) || ' ' || lower(p_type) as vendor_b, round(1 - "
    "levenshtein(lower(p_name), lower(upper(p_name) || ' ' || lower(p_type)))::double / "
    "greatest(length(p_name), length(p_name) + 1 + length(p_type)), 3) as similarity, count(*) as n from part group by all",
)
def vendor_similarity_lev(spark, root):
    scored = entities.vendor_similarity_lev(_name_pairs(spark, root))
    return scored.groupBy("vendor_a", "vendor_b", "similarity").agg(F.count("*").alias("n"))


def _part_names(spark, root):
    parts = tb.table(spark, root, "part")
    return parts.selectExpr("p_name as vendor"), parts.selectExpr("p_name || ' co' as vendor")


@query(
    "fuzzy_vendor_pairs",
    "with a as (select distinct p_name as x from part), s as (select a.x as vendor_a, b.x || ' co' as vendor_b, round(1 - "
    "levenshtein(lower(trim(a.x)), lower(trim(b.x || ' co')))::double / greatest(length(trim(a.x)), length(trim(b.x || ' co'))), 3) as similarity "
    "from a, a b) select * from s where similarity >= 0.7",
)
def fuzzy_vendor_pairs(spark, root):
    return entities.fuzzy_vendor_pairs(*_part_names(spark, root), 0.7)


@query("fuzzy_vendor_pairs_sequence")
def fuzzy_vendor_pairs_sequence(spark, root):
    return entities.fuzzy_vendor_pairs_sequence(*_part_names(spark, root), 0.85)


_RECEIPT_BEST = """
  select r.txn_id as receipt_id, best.txn_id as matched_transaction_id,
    coalesce(round(best.score, 3), 0.0) as confidence, round(best.gap, 2) as amount_delta, best.days::int as date_delta_days
  from receipts r left join (
    select * from (select *, row_number() over (partition by receipt_id order by score desc, date, txn_id) as k from (
      select r.txn_id as receipt_id, t.txn_id, t.date, abs(t.amount - r.amount) as gap, {days} as days,
        round((1 - abs(t.amount - r.amount) / r.amount) * 0.4 + (1 - {days} / 7.0) * 0.3 + 0.3 *
          coalesce(round(1 - levenshtein(lower(t.vendor), lower(r.vendor))::double / greatest(length(t.vendor), length(r.vendor)), 3), 0), 9)
          as score
      from receipts r join cards t on t.date between r.date - to_days(7) and r.date + to_days(7)
        and t.amount between r.amount * 0.95 and r.amount * 1.05)) where k = 1) best on r.txn_id = best.receipt_id
""".format(days=_DAYS.format(a="t.date", b="r.date"))


@query("match_receipts_lev", sql(_RECEIPT_BEST, "cards", "receipts"))
def match_receipts_lev(spark, root):
    return receipts.match_receipts(tb.receipts(spark, root), tb.cards(spark, root), similarity="levenshtein")


@query("match_receipts")
def match_receipts(spark, root):
    return receipts.match_receipts(tb.receipts(spark, root), tb.cards(spark, root))


@query(
    "orphan_transactions",
    sql(
        "with t as (select * from cards where vendor is not null union all select * from bank where vendor is not null "
        "union all select * from receipts where vendor is not null) "
        "select txn_id, source, amount, vendor from (select *, min(source) over w as lo, max(source) over w as hi from t "
        "window w as (partition by vendor, coalesce(cast(amount as varchar), 'nan'), coalesce(cast(date as varchar), 'NaT'))) "
        "where lo = hi",
        "cards",
        "bank",
        "receipts",
    ),
)
def orphan_transactions(spark, root):
    txns = gold.gold_union(tb.cards(spark, root), tb.bank(spark, root), tb.receipts(spark, root))
    out = reconcile.orphan_transactions(txns, ["credit_card", "bank", "receipts"])
    return out.select("txn_id", "source", "amount", "vendor")


@query(
    "missing_receipts",
    sql(
        "select txn_id, vendor, amount from cards c where date < timestamp '2001-11-10' - to_days(7) "
        "and (vendor is null or vendor not in ('Supplier#000000001', 'Supplier#000000004')) and not exists (select 1 from receipts r "
        "where r.vendor = c.vendor and abs(r.amount - c.amount) / abs(c.amount) <= 0.05 and "
        + _DAYS.format(a="c.date", b="r.date")
        + " <= 7)",
        "cards",
        "receipts",
    ),
)
def missing_receipts(spark, root):
    out = reconcile.missing_receipts(
        tb.cards(spark, root),
        tb.receipts(spark, root),
        AS_OF,
        exclude_vendors=["Supplier#000000001", "Supplier#000000004"],
    )
    return out.select("txn_id", "vendor", "amount")


@query(
    "receipt_coverage",
    sql(
        "select source, count(*) as rows, strftime(min(date), '%Y-%m-%d') as first_date, strftime(max(date), '%Y-%m-%d') "
        "as last_date, case when source = 'receipts' then round(count(*) / (select count(*) from cards)::double, 3) end as coverage "
        "from (select * from cards union all select * from bank union all select * from receipts) group by source",
        "cards",
        "bank",
        "receipts",
    ),
)
def receipt_coverage(spark, root):
    out = reconcile.receipt_coverage(tb.cards(spark, root), tb.bank(spark, root), tb.receipts(spark, root))
    return out.select("source", "rows", day("first_date"), day("last_date"), "coverage")


# ---- anomalies ---------------------------------------------------------------------------------------


@query(
    "anomaly_features",
    sql(
        "select txn_id, round(coalesce(ln(1 + amount), 0), 6) as log_amount, "
        "(('0x' || substr(md5(coalesce(vendor_id, 'unknown')), 1, 8))::ubigint % 1000)::int as vendor_encoded, "
        "coalesce(isodow(date) - 1, 0)::int as day_of_week, coalesce(day(date), 0)::int as day_of_month from cards",
        "cards",
    ),
)
def anomaly_features(spark, root):
    return anomaly.anomaly_features(tb.cards(spark, root)).withColumn("log_amount", F.round("log_amount", 6))


@query(
    "vendor_history_features",
    sql(
        "with d as (select vendor_id, date, date_diff('day', lag(date) over (partition by vendor_id order by date), date) as gap "
        "from (select distinct vendor_id, date from cards where date is not null)), "
        "m as (select vendor_id, avg(amount) as mean from cards group by vendor_id) "
        "select txn_id, gap::int as days_since_previous, round(amount - mean + 1e-9, 4) as amount_minus_vendor_mean "
        "from cards c left join d on c.vendor_id = d.vendor_id and c.date = d.date join m on m.vendor_id = c.vendor_id",
        "cards",
    ),
)
def vendor_history_features(spark, root):
    out = anomaly.vendor_history_features(tb.cards(spark, root))
    return out.withColumn("amount_minus_vendor_mean", rounded("amount_minus_vendor_mean", 4))


_PROFILE_SQL = (
    "profiles as (select vendor_id, min(vendor) as vendor_name, avg(amount) as mean_amount, "
    "coalesce(stddev_samp(amount), 0) as std_dev, count(*) / ((year(max(date)) - year(min(date))) * 12 + month(max(date)) - "
    "month(min(date)) + 1)::double as frequency, max(date) as last_transaction_date from cards group by vendor_id)"
)


@query(
    "build_vendor_profiles",
    sql(
        f"with {_PROFILE_SQL}, dom as (select vendor_id, d from (select vendor_id, d, row_number() over (partition by vendor_id "
        "order by n desc, d) as r from (select vendor_id, day(date) as d, count(*) as n from cards where date is not null "
        "group by 1, 2)) where r = 1) select vendor_id, vendor_name, round(mean_amount + 1e-9, 4) as mean_amount, "
        "round(std_dev + 1e-9, 4) as std_dev, round(frequency, 4) as frequency, d::int as typical_day_of_month, "
        "strftime(last_transaction_date, '%Y-%m-%d') as last_transaction_date from profiles left join dom using (vendor_id)",
        "cards",
    ),
)
def build_vendor_profiles(spark, root):
    out = anomaly.build_vendor_profiles(tb.cards(spark, root))
    exact = {"mean_amount": rounded("mean_amount", 4), "std_dev": rounded("std_dev", 4), "frequency": F.round("frequency", 4)}
    return out.withColumns(exact).withColumn("last_transaction_date", day("last_transaction_date"))


@query(
    "vendor_outliers",
    sql(
        f"with {_PROFILE_SQL} select txn_id, coalesce(abs((amount - mean_amount) / nullif(std_dev, 0)), 0) > 1.5 as is_outlier, "
        "round(coalesce((amount - mean_amount) / nullif(std_dev, 0), 0), 2) + 0.0::double as z_score, round(mean_amount, 2) as vendor_mean, "
        "round(std_dev, 2) as vendor_std from cards left join profiles using (vendor_id)",
        "cards",
    ),
)
def vendor_outliers(spark, root):
    cards = tb.cards(spark, root)
    out = anomaly.vendor_outliers(cards, anomaly.build_vendor_profiles(cards), AnomalyParams(profile_sigma=1.5))
    return out.drop("explanation")


@query(
    "amount_outliers",
    sql(
        "select txn_id, amount, round(z, 6) as z_score from (select *, (amount - avg(amount) over ()) / stddev_samp(amount) over () "
        "as z from cards) where abs(z) > 1.6",
        "cards",
    ),
)
def amount_outliers(spark, root):
    return anomaly.amount_outliers(tb.cards(spark, root), sigma=1.6).withColumn("z_score", F.round("z_score", 6))


@query(
    "amount_outliers_by_vendor",
    sql(
        "select txn_id, vendor_id, amount, round(z, 6) as z_score from (select *, (amount - avg(amount) over w) / "
        "stddev_samp(amount) over w as z, count(amount) over w as n from cards window w as (partition by vendor_id)) "
        "where abs(z) > 1.6 and n >= 5",
        "cards",
    ),
)
def amount_outliers_by_vendor(spark, root):
    out = anomaly.amount_outliers_by_vendor(tb.cards(spark, root), sigma=1.6)
    return out.withColumn("z_score", F.round("z_score", 6))


@query(
    "rolling_deviation",
    sql(
        "select vendor_id, txn_id, amount, round(m, 4) as rolling_mean, round(abs(amount - m) / m * 100, 4) as deviation_pct from "
        "(select *, avg(amount) over (partition by vendor_id order by date, txn_id, amount rows between 2 preceding and current row) "
        "as m, count(*) over (partition by vendor_id) as n from cards where amount is not null and date is not null) "
        "where abs(amount - m) / m * 100 > 20 and n >= 3",
        "cards",
    ),
)
def rolling_deviation(spark, root):
    out = anomaly.rolling_deviation(tb.cards(spark, root))
    return out.withColumns({c: F.round(c, 4) for c in ("rolling_mean", "deviation_pct")})


@query(
    "late_payments",
    sql(
        "with g as (select vendor_id, d, date_diff('day', lag(d) over (partition by vendor_id order by d), d) as gap from "
        "(select distinct vendor_id, cast(date as date) as d from cards where date is not null)), "
        "u as (select vendor_id, median(gap) as usual, count(gap) as n from g where gap is not null group by 1) "
        "select vendor_id, strftime(d, '%Y-%m-%d') as payment_day, gap::int as gap_days, usual::double as usual_gap_days, "
        "(gap - usual)::double as days_late from g join u using (vendor_id) where gap > usual + 5 and n >= 2",
        "cards",
    ),
)
def late_payments(spark, root):
    return anomaly.late_payments(tb.cards(spark, root)).withColumn("payment_day", day("payment_day"))


_SIGNALS_SQL = (
    "with s as (select txn_id, coalesce(amount > 4500, false) as f, coalesce(amount < 100, false) as v, vendor is null as a, "
    "date is null as t from cards) select txn_id, 30 * f::int + 30 * v::int + 20 * a::int + 20 * t::int as anomaly_score, "
    "concat_ws(',', case when f then 'isolation_forest' end, case when v then 'vendor_outlier' end, "
    "case when a then 'amount_outlier' end, case when t then 'time_series_deviation' end) as reasons, "
    "30 * f::int + 30 * v::int + 20 * a::int + 20 * t::int > 60 as high_risk from s"
)


@query("anomaly_score", sql(_SIGNALS_SQL, "cards"))
def anomaly_score(spark, root):
    signals = tb.cards(spark, root).select(
        "txn_id",
        (F.col("amount") > 4500).alias("is_anomaly_if"),
        (F.col("amount") < 100).alias("is_vendor_outlier"),
        F.col("vendor").isNull().alias("is_amount_outlier"),
        F.col("date").isNull().alias("is_time_series_deviation"),
    )
    out = anomaly.anomaly_score(signals, AnomalyParams(high_risk=60))
    return out.select("txn_id", "anomaly_score", joined("reasons"), "high_risk")


@query("isolation_forest_score")
def isolation_forest_score(spark, root):
    features = anomaly.anomaly_features(tb.cards(spark, root))
    _, scores = iforest.isolation_forest_fit_score(features)
    return scores.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("isolation_forest_fit")
def isolation_forest_fit(spark, root):
    """Shape of the fitted trees: nodes and leaves per tree."""
    forest = iforest.isolation_forest_fit(anomaly.anomaly_features(tb.cards(spark, root)))
    rows = [(t[0], len(t[1]), sum(1 for f in t[1] if f < 0)) for t in forest.trees]
    return spark.createDataFrame(rows, "tree int, nodes int, leaves int")


@query(
    "anomaly_report",
    sql(
        f"with {_PROFILE_SQL}, v as (select txn_id from cards join profiles using (vendor_id) where "
        "abs((amount - mean_amount) / nullif(std_dev, 0)) > 1.6), a as (select txn_id from (select *, (amount - avg(amount) over ()) / "
        "stddev_samp(amount) over () as z from cards) where abs(z) > 1.6), t as (select txn_id from (select *, avg(amount) over "
        "(partition by vendor_id order by date, txn_id, amount rows between 2 preceding and current row) as m, count(*) over "
        "(partition by vendor_id) as n from cards where amount is not null and date is not null) "
        "where abs(amount - m) / m * 100 > 20 and n >= 3), i as (select distinct txn_id, txn_id in (select txn_id from v) as v, "
        "txn_id in (select txn_id from a) as a, txn_id in (select txn_id from t) as t from cards) "
        "select txn_id, 30 * v::int + 20 * a::int + 20 * t::int as anomaly_score, concat_ws(',', case when v then 'vendor_outlier' "
        "end, case when a then 'amount_outlier' end, case when t then 'time_series_deviation' end) as reasons from i",
        "cards",
    ),
)
def anomaly_report(spark, root):
    cards = tb.cards(spark, root)
    p = AnomalyParams(profile_sigma=1.6, amount_sigma=1.6)
    out = anomaly.anomaly_report(cards, anomaly.build_vendor_profiles(cards), None, p)
    return out.select("txn_id", "anomaly_score", joined("reasons"))


# ---- context -----------------------------------------------------------------------------------------

_EMAIL_SQL = """
  with asked as (select distinct vendor, date from cards where vendor is not null and date is not null),
  hits as (select a.vendor, a.date, e.email_id, case when contains(lower(subject), lower(vendor)) then 0.9 else 0.7 end as c,
      abs(epoch_us(email_date) - epoch_us(a.date)) as gap from asked a join emails e
      on e.email_date between a.date - to_days(3) and a.date + to_days(3) and (contains(subject, vendor) or contains(body, vendor))),
  best as (select vendor, date, string_agg(email_id || ':' || c, ',' order by c desc, gap, email_id) as matches, count(*) as n from
    hits group by 1, 2)
  select txn_id, coalesce(matches, '') as email_matches, coalesce(n, 0)::int as match_count
  from cards c left join best b on c.vendor = b.vendor and c.date = b.date
"""


@query("email_matches", sql(_EMAIL_SQL, "cards", "emails"))
def email_matches(spark, root):
    out = context.email_matches(tb.cards(spark, root), tb.emails(spark, root))
    text = F.transform("email_matches", lambda m: F.concat(m["email_id"], F.lit(":"), m["confidence"].cast("string")))
    return out.select("txn_id", F.array_join(text, ",").alias("email_matches"), "match_count")


_CALENDAR_SQL = """
  with asked as (select distinct vendor, date from cards where vendor is not null and date is not null),
  hits as (select a.vendor, a.date, e.event_id, abs(epoch_us(event_date) - epoch_us(a.date)) as gap from asked a join calendar e
      on e.event_date between a.date - to_days(3) and a.date + to_days(3) and (contains(title, vendor) or contains(description, vendor))),
  best as (select vendor, date, string_agg(event_id, ',' order by gap, event_id) as matches, count(*) as n from
    hits group by 1, 2)
  select txn_id, coalesce(matches, '') as calendar_matches, coalesce(n, 0)::int as match_count
  from cards c left join best b on c.vendor = b.vendor and c.date = b.date
"""


@query("calendar_matches", sql(_CALENDAR_SQL, "cards", "calendar"))
def calendar_matches(spark, root):
    out = context.calendar_matches(tb.cards(spark, root), tb.calendar(spark, root))
    ids = F.array_join(F.transform("calendar_matches", lambda m: m["event_id"]), ",")
    return out.select("txn_id", ids.alias("calendar_matches"), "match_count")


_WORD = "coalesce(" + ", ".join(f"case when contains(lower(body), '{k}') then '{k}' end" for k in APPROVAL_KEYWORDS) + ")"
_APPROVAL_SQL = f"""
  with h as (select *, {_WORD} as word from emails),
  f as (select *, row_number() over (partition by thread_id order by email_date, email_id) as r from h where word is not null)
  select t.thread_id, f.word is not null as approved, f.sender as approver,
    strftime(f.email_date, '%Y-%m-%d %H:%M:%S') as approved_at, f.word as approval_keyword
  from (select distinct thread_id from emails) t left join f on f.thread_id = t.thread_id and f.r = 1
"""


@query("approval_chains", sql(_APPROVAL_SQL, "emails"))
def approval_chains(spark, root):
    out = context.approval_chains(tb.emails(spark, root))
    return out.withColumn("approved_at", second("approved_at"))


_FILES_SQL = """
  with asked as (select distinct vendor, amount, date from cards where vendor is not null and amount > 0 and date is not null),
  hits as (select a.vendor, a.amount, a.date, file_path, row_number() over (partition by a.vendor, a.amount, a.date order by
      abs(epoch_us(ocr_date::timestamp) - epoch_us(a.date)), abs(ocr_amount - a.amount), receipt_id) as k
    from asked a join receipts_ocr o on contains(o.ocr_vendor, a.vendor) and o.ocr_date between a.date - to_days(7) and a.date + to_days(7)
      and o.ocr_amount between a.amount * 0.95 and a.amount * 1.05),
  best as (select vendor, amount, date, string_agg(file_path, ',' order by k) as files, count(*) as n from hits group by 1, 2, 3)
  select txn_id, coalesce(files, '') as file_paths, coalesce(n, 0)::int as match_count
  from cards c left join best b on c.vendor = b.vendor and c.amount = b.amount and c.date = b.date
"""


@query("receipt_files", sql(_FILES_SQL, "cards", "receipts_ocr"))
def receipt_files(spark, root):
    out = context.receipt_files(tb.cards(spark, root), tb.receipts_ocr(spark, root))
    return out.select("txn_id", joined("file_paths"), "match_count")


_KEYWORDS = ["the", "und", "que"]
_KEYWORD_SQL = "coalesce(" + ", ".join(f"case when contains(title, '{k}') or contains(content, '{k}') then '{k}' end" for k in _KEYWORDS) + ")"


@query(
    "keyword_search",
    sql(f"select doc_id, title, snippet, {_KEYWORD_SQL} as keyword, 0.8::double as relevance from docs where {_KEYWORD_SQL} is not null", "docs"),
)
def keyword_search(spark, root):
    return context.keyword_search(tb.documents(spark, root), _KEYWORDS)


@query(
    "embedding_search",
    """with x as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings),
    q as (select label, p, round(avg(v), 9) as v from x group by 1, 2),
    qn as (select label, sqrt(sum(v * v)) as n from q group by 1), xn as (select vec_id, sqrt(sum(v * v)) as n from x group by 1),
    s as (select q.label, x.vec_id, sum(q.v * x.v) as d from q join x on q.p = x.p group by 1, 2),
    r as (select label as query_id, vec_id as doc_id, d / (xn.n * qn.n) as sim from s join qn using (label) join xn using (vec_id))
    select query_id, doc_id, round(sim, 6) as similarity, rank::int as rank from (select *, row_number() over (partition by query_id
    order by round(sim, 9) desc, doc_id) as rank from r) where rank <= 5""",
)
def embedding_search(spark, root):
    vectors = tb.table(spark, root, "embeddings")
    mean = (
        vectors.select("label", F.posexplode("embedding").alias("p", "v"))
        .groupBy("label", "p")
        .agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l"))
        .select(F.col("label").alias("query_id"), F.transform("l", lambda e: e["v"]).alias("embedding"))
    )
    out = context.embedding_search(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), mean)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "embedding_neighbours",
    """with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings),
    n as (select vec_id, sqrt(sum(v * v)) as n from x group by 1),
    s as (select q.vec_id as query_id, x.vec_id as doc_id, sum(q.v * x.v) as d from x q join x on q.p = x.p where q.vec_id % 20 = 0 group by 1, 2),
    r as (select query_id, doc_id, d / (a.n * b.n) as sim from s join n a on a.vec_id = query_id join n b on b.vec_id = doc_id)
    select query_id, doc_id, round(sim, 6) as similarity, rank::int as rank from (select *, row_number() over (partition by query_id
    order by round(sim, 9) desc, doc_id) as rank from r) where rank <= 5""",
)
def embedding_neighbours(spark, root):
    """Every vector whose id is divisible by 20 as a query against all vectors."""
    vectors = tb.table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = context.embedding_search(vectors, vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "enriched_transactions",
    sql(
        "with approvals as (" + _APPROVAL_SQL.strip() + "), mails as (select distinct c.txn_id from cards c join ("
        "select a.vendor, a.date, e.email_id from (select distinct vendor, date from cards) a "
        "join emails e on e.email_date between a.date - to_days(3) and a.date + to_days(3) "
        "and (contains(subject, vendor) or contains(body, vendor))) m on c.vendor = m.vendor and c.date = m.date "
        "join emails e on e.email_id = m.email_id join approvals p on p.thread_id = e.thread_id and p.approved), "
        "cal as (" + _CALENDAR_SQL.strip() + "), files as (" + _FILES_SQL.strip() + ") "
        "select txn_id, txn_id in (select txn_id from mails) as email_approval, nullif(split_part(calendar_matches, ',', 1), '') "
        "as calendar_event, f.match_count > 0 as receipt_found, round(0.10 + ((txn_id in (select txn_id from mails))::int + "
        "(calendar_matches <> '')::int + (f.match_count > 0)::int) * 0.85 / 3, 3)::double as confidence "
        "from cards join cal using (txn_id) join files f using (txn_id)",
        "cards",
        "emails",
        "calendar",
        "receipts_ocr",
    ),
)
def enriched_transactions(spark, root):
    out = context.enriched_transactions(
        tb.cards(spark, root), tb.emails(spark, root), tb.calendar(spark, root), tb.receipts_ocr(spark, root)
    )
    return out.withColumn("calendar_event", F.col("calendar_event.event_id"))


# ---- escalation --------------------------------------------------------------------------------------

_FINDINGS_SQL = (
    "select txn_id, vendor, amount, coalesce(date, timestamp '1900-01-01') <= timestamp '1997-06-30' as is_unmatched, "
    "vendor is null or amount is null or date is null as is_incomplete, coalesce(vendor_id in ('3', '5', '7'), false) as is_duplicate "
    "from cards"
)


def _findings(spark, root):
    cards = tb.cards(spark, root)
    return cards.select(
        "txn_id",
        "vendor",
        "vendor_id",
        "date",
        "amount",
        F.coalesce(F.col("date") <= F.lit("1997-06-30").cast("timestamp"), F.lit(True)).alias("is_unmatched"),
        filters.is_incomplete(cards).alias("is_incomplete"),
        F.col("vendor_id").isin("3", "5", "7").alias("is_duplicate"),
    )


_LIVE_SQL = f"""
  select *, case when score >= 70 then 'CRITICAL' when score >= 50 then 'WARNING' else 'INFO' end as severity_level from (
    select *, 50 * is_unmatched::int + 30 * is_incomplete::int + 40 * is_duplicate::int + 20 * coalesce(amount >= 5000, false)::int
      as score, concat_ws(',', case when is_unmatched then 'no_reconciliation_match' end,
      case when is_incomplete then 'incomplete_data' end, case when is_duplicate then 'duplicate_transaction' end,
      case when amount >= 5000 then 'high_amount' end) as factors from ({_FINDINGS_SQL}))
  where factors <> '' and not (factors = 'no_reconciliation_match' and coalesce(amount < 5000, false))
"""


@query(
    "severity_live",
    sql(f"select txn_id, least(score, 100) as severity_score, severity_level, factors from ({_LIVE_SQL})", "cards"),
)
def severity_live(spark, root):
    out = escalate.severity_live(_findings(spark, root))
    return out.select("txn_id", "severity_score", "severity_level", joined("factors"))


_TOOL_SQL = f"""
  select txn_id, least(score, 100) as severity_score, case when score >= 70 then 'CRITICAL' when score >= 50 then 'WARNING'
    else 'INFO' end as severity_level, round(least(n / 3.0, 1), 2)::double as confidence_score from (
    select txn_id, 50 * is_unmatched::int + 30 * is_incomplete::int + 20 * coalesce(amount > 4000, false)::int as score,
      is_unmatched::int + is_incomplete::int + coalesce(amount > 4000, false)::int as n from ({_FINDINGS_SQL}))
"""


@query("severity_tool", sql(_TOOL_SQL, "cards"))
def severity_tool(spark, root):
    rows = _findings(spark, root).select(
        "txn_id", "amount", (~F.col("is_unmatched")).alias("matched"), F.col("is_incomplete").alias("incomplete")
    )
    out = escalate.severity_tool(rows, SeverityParams(weights=TOOL_SEVERITY.weights, high_amount=4000.0))
    return out.select("txn_id", "severity_score", "severity_level", "confidence_score")


_FULL_SQL = f"""
  select txn_id, score as severity_score, case when score >= 80 then 'CRITICAL' when score >= 50 then 'WARNING' else 'INFO' end
    as severity_level, score < 20 as below_info from (select txn_id, 40 * is_unmatched::int + 30 * coalesce(amount > 3500, false)::int
    + 20 * is_incomplete::int + 10 * (not is_duplicate)::int as score from ({_FINDINGS_SQL}))
"""


@query("severity_full", sql(_FULL_SQL, "cards"))
def severity_full(spark, root):
    rows = _findings(spark, root).select(
        "txn_id",
        (~F.col("is_unmatched")).alias("matched"),
        F.when(F.col("amount") > 3500, F.lit(90)).otherwise(F.lit(10)).alias("anomaly_score"),
        (~F.col("is_incomplete")).alias("email_approval"),
        F.col("is_duplicate").alias("receipt_found"),
    )
    return escalate.severity_full(rows).select("txn_id", "severity_score", "severity_level", "below_info")


_EXPLAIN_SQL = f"""
  select txn_id, 'Flagged because: ' || concat_ws('; ',
    case when contains(factors, 'no_reconciliation_match') then 'No matching bank transaction found for $' ||
      coalesce(printf('%.2f', amount), 'nan') || ' to ' || coalesce(vendor, 'Unknown') end,
    case when contains(factors, 'incomplete_data') then 'Transaction ' || txn_id || ' is missing required fields' end,
    case when contains(factors, 'duplicate_transaction') then 'Transaction ' || txn_id || ' appears to be a duplicate' end,
    case when contains(factors, 'high_amount') then 'Transaction amount $' || coalesce(printf('%.2f', amount), 'nan') ||
      ' exceeds high-value threshold' end) || '.' as explanation from ({_LIVE_SQL})
"""


@query("explain", sql(_EXPLAIN_SQL, "cards"))
def explain(spark, root):
    return escalate.explain(escalate.severity_live(_findings(spark, root))).select("txn_id", "explanation")


_ESCALATED_SQL = f"""
  select txn_id, case when s = 'INFO' and coalesce(amount < 50, false) then 'AUTO_APPROVED' else s end as severity_level, cfo_notice from (
    select *, case when vendor in ('Supplier#000000003', 'Supplier#000000005') and severity_level = 'WARNING' then 'INFO'
      else severity_level end as s, severity_level = 'CRITICAL' and coalesce(amount > 1000, false) as cfo_notice from ({_LIVE_SQL}))
"""


def _whitelist(spark):
    return spark.createDataFrame([("Supplier#000000003",), ("Supplier#000000005",)], "vendor string")


@query("escalation_rules", sql(_ESCALATED_SQL, "cards"))
def escalation_rules(spark, root):
    scored = escalate.severity_live(_findings(spark, root))
    return escalate.escalation_rules(scored, _whitelist(spark)).select("txn_id", "severity_level", "cfo_notice")


_RECURRING_SQL = f"""
  with l as ({_LIVE_SQL}), n as (select vendor_id, count(*) as n from cards where amount is not null and date is not null group by 1),
  d as (select txn_id from (select *, avg(amount) over (partition by vendor_id order by date, txn_id, amount rows between 2 preceding
    and current row) as m from cards where amount is not null and date is not null) where abs(amount - m) / m * 100 >= 5)
  select l.txn_id, case when n >= 3 and c.amount is not null and c.date is not null and l.txn_id not in (select txn_id from d) then
    case severity_level when 'CRITICAL' then 'WARNING' else 'INFO' end else severity_level end as severity_level
  from l join cards c using (txn_id) left join n using (vendor_id)
"""


@query("recurring_downgrade", sql(_RECURRING_SQL, "cards"))
def recurring_downgrade(spark, root):
    scored = escalate.severity_live(_findings(spark, root))
    return escalate.recurring_downgrade(scored, tb.cards(spark, root)).select("txn_id", "severity_level")


_FLAGS_SQL = f"""
  select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
    as flag_id, txn_id as transaction_id, severity_level from (
    select *, sha256('run-1|' || txn_id) as h from ({_ESCALATED_SQL}) where severity_level <> 'AUTO_APPROVED')
"""


@query("create_flags", sql(_FLAGS_SQL, "cards"))
def create_flags(spark, root):
    scored = escalate.escalation_rules(escalate.severity_live(_findings(spark, root)), _whitelist(spark))
    flags = escalate.create_flags(escalate.explain(scored), "run-1", AS_OF)
    return flags.select("flag_id", "transaction_id", "severity_level")


@query(
    "audit_summary",
    sql(
        "select 'run-1' as audit_run_id, 'completed' as status, (select count(*) from cards) as transactions_processed, "
        "count(*) as flags_created, count(*) filter (severity_level = 'CRITICAL') as critical, "
        "count(*) filter (severity_level = 'WARNING') as warning, count(*) filter (severity_level = 'INFO') as info, "
        f"round(count(*) / (select count(*) from cards)::double, 4) as flag_rate from ({_FLAGS_SQL})",
        "cards",
    ),
)
def audit_summary(spark, root):
    cards = tb.cards(spark, root)
    scored = escalate.escalation_rules(escalate.severity_live(_findings(spark, root)), _whitelist(spark))
    flags = escalate.create_flags(escalate.explain(scored), "run-1", AS_OF)
    return escalate.audit_summary("run-1", cards, flags).drop("suspicious_transactions")


def _audit_oracle() -> str:
    matching_sql = _matching_oracle().replace("from cards c join bank b", "from cards_rep c join bank b").replace(
        "row_number() over (order by date_1, amount_1, v1, k1, source_1_id)",
        "dense_rank() over (order by date_1, amount_1, v1, k1, source_1_id)",
    )
    # ids repeat on the card side, so rows are told apart by (id, date, amount, vendor id)
    matching_sql = matching_sql.replace(
        "ranks_i as materialized (select source_1_id, min(i) as ri from e0 group by 1)",
        "ranks_i as materialized (select source_1_id, date_1, amount_1, v1, k1, min(i) as ri from e0 group by all)",
    ).replace("join ranks_i using (source_1_id)", "join ranks_i using (source_1_id, date_1, amount_1, v1, k1)")
    return (
        f"with {matching_sql}, first as (select txn_id, n, vendor, amount, (txn_id not in (select source_1_id from pairs)) or high "
        "as is_unmatched, is_incomplete, n > 1 as is_duplicate from (select *, count(*) over (partition by txn_id) as n, "
        "bool_or(vendor is null or amount is null or date is null) over (partition by txn_id) as is_incomplete, "
        "bool_or(coalesce(amount >= 5000, false)) over (partition by txn_id) as high, row_number() over (partition by txn_id "
        "order by date nulls first, amount nulls first, vendor nulls first, vendor_id) as r from cards_rep) where r = 1), "
        + "live as ("
        + _LIVE_SQL.replace(f"({_FINDINGS_SQL})", "first")
        + ") select txn_id as transaction_id, severity_level, factors, round(least(len(string_split(factors, ',')) / 3.0, 1), 2)::double "
        "as confidence_score from live where not (severity_level = 'INFO' and coalesce(amount < 50, false))"
    )


@query("run_audit", sql(_audit_oracle(), "cards_rep", "bank"))
def run_audit(spark, root):
    result = audit.run_audit(tb.cards(spark, root, repeated_ids=True), tb.bank(spark, root), "run-1", AS_OF)
    return result.flags.select("transaction_id", "severity_level", joined("factors"), "confidence_score")


_FULL = AnomalyParams(profile_sigma=1.6, amount_sigma=1.6, high_risk=30)
_FULL_SQL = sql(
    f"with {_matching_oracle()}, an as materialized (select * from ({ORACLES['anomaly_report']})), en as materialized (select * from ({ORACLES['enriched_transactions']})), "
    "j as (select c.*, c.txn_id in (select source_1_id from pairs) as matched, coalesce(an.anomaly_score, 0) as anomaly, coalesce(email_approval, false) as mail, "
    "coalesce(receipt_found, false) as receipt from cards c left join an using (txn_id) left join en using (txn_id)), "
    "s as (select *, 40 * (not matched)::int + 30 * (anomaly > 30)::int + 20 * (not mail)::int + 10 * (not receipt)::int as score, "
    "concat_ws(',', case when not matched then 'no_reconciliation_match' end, case when anomaly > 30 then 'high_anomaly_score' end, "
    "case when not mail then 'no_email_approval' end, case when not receipt then 'no_receipt' end) as factors, "
    "(not matched)::int + (anomaly > 30)::int + (not mail)::int + (not receipt)::int as n from j "
    "where not matched or anomaly > 0 or vendor is null or amount is null or date is null), "
    "f as (select txn_id as transaction_id, case when score >= 80 then 'CRITICAL' when score >= 50 then 'WARNING' else 'INFO' end as severity_level, factors, "
    "round(least(n / 3.0, 1), 2)::double as confidence_score, amount from s where score >= 20) "
    "select transaction_id, severity_level, factors, confidence_score from f where not (severity_level = 'INFO' and coalesce(amount < 50, false))",
    "cards",
    "bank",
)


def _full_audit(spark, root):
    tables = tb.cards(spark, root), tb.bank(spark, root), tb.emails(spark, root), tb.calendar(spark, root), tb.receipts_ocr(spark, root)
    return audit.full_audit(*tables, "run-1", AS_OF, anomaly=_FULL)


@query("full_audit", _FULL_SQL)
def full_audit(spark, root):
    return _full_audit(spark, root).flags.select("transaction_id", "severity_level", joined("factors"), "confidence_score")


@query(
    "full_audit_trail",
    sql(
        f"with f as materialized (select * from ({_FULL_SQL})), {_matching_oracle()}, an as materialized (select * from ({ORACLES['anomaly_report']})), "
        "q as (select 1 - sum((vendor is null)::int + (amount is null)::int + (date is null)::int + (source is null)::int) / (count(*) * 4)::double as c from cards) "
        "select 1::bigint as log_sequence_number, 'DataQuality' as agent_name, 'completeness ' || round(c, 3) as output_summary from q "
        "union all select 2, 'Reconciliation', (select count(*) from pairs) || ' pairs' "
        "union all select 3, 'AnomalyDetection', (select count(*) from an where anomaly_score > 0) || ' anomalous ids' "
        "union all select 4, 'ContextEnrichment', count(*) || ' suspicious ids' from cards where txn_id not in (select source_1_id from pairs) "
        "or txn_id in (select txn_id from an where anomaly_score > 0) or vendor is null or amount is null or date is null "
        "union all select 5, 'Escalation', count(*) || ' flags' from f "
        "union all select 6, 'Logging', count(*) || ' rows audited' from cards",
        "cards",
        "bank",
    ),
)
def full_audit_trail(spark, root):
    return _full_audit(spark, root).trail.select("log_sequence_number", "agent_name", "output_summary")


@query("run_audit_summary")
def run_audit_summary(spark, root):
    return audit.run_audit(tb.cards(spark, root, repeated_ids=True), tb.bank(spark, root), "run-1", AS_OF).summary


# ---- feedback ----------------------------------------------------------------------------------------


def _reviews(spark, root):
    """Two review rounds per flag, the later one wins."""
    flags = tb.flags(spark, root)
    first = flags.selectExpr("flag_id", "'rejected' as human_decision", "'r1' as reviewer_id", "created_at as review_timestamp", "'' as reviewer_notes")
    later = flags.filter("reviewed").selectExpr(
        "flag_id", "human_decision", "'r2' as reviewer_id", "created_at + interval 1 day as review_timestamp", "'seen' as reviewer_notes"
    )
    return first.unionByName(later)


@query(
    "apply_reviews",
    sql(
        "select flag_id, true as reviewed, case when reviewed then human_decision else 'rejected' end as human_decision, "
        "case when reviewed then 'r2' else 'r1' end as reviewer_id from flags",
        "flags",
    ),
)
def apply_reviews(spark, root):
    bare = tb.flags(spark, root).drop("reviewed", "human_decision", "review_timestamp")
    out = feedback.apply_reviews(bare, _reviews(spark, root))
    return out.select("flag_id", "reviewed", "human_decision", "reviewer_id")


_RATE = (
    "count(*) filter (reviewed and human_decision = 'false_positive') as false_positives, count(*) as flags, "
    "round(count(*) filter (reviewed and human_decision = 'false_positive') / count(*)::double, 6) as fp_rate"
)
_RECENT = "created_at > timestamp '2000-06-15' - to_days(60)"


@query(
    "fp_rate_by_vendor",
    sql(
        f"select * from (select vendor_id, min(vendor) as vendor, {_RATE} from flags where {_RECENT} and vendor_id is not null "
        "group by vendor_id) where false_positives > 0",
        "flags",
    ),
)
def fp_rate_by_vendor(spark, root):
    out = feedback.fp_rate_by_vendor(tb.flags(spark, root), FLAGS_AS_OF, 60)
    return out.withColumn("fp_rate", F.round("fp_rate", 6))


@query(
    "vendors_to_whitelist",
    sql(
        f"select vendor_id, vendor, fp_rate from (select vendor_id, min(vendor) as vendor, {_RATE} from flags where {_RECENT} "
        "and vendor_id is not null group by vendor_id) where fp_rate > 0.6 and vendor_id not in ('3', '5')",
        "flags",
    ),
)
def vendors_to_whitelist(spark, root):
    rates = feedback.fp_rate_by_vendor(tb.flags(spark, root), FLAGS_AS_OF, 60)
    listed = spark.createDataFrame([("3",), ("5",)], "vendor_id string")
    return feedback.vendors_to_whitelist(rates, listed, 0.6).withColumn("fp_rate", F.round("fp_rate", 6))


_RULE_RATES = f"select * from (select rule, {_RATE} from (select *, unnest(factors) as rule from flags) where {_RECENT} group by rule) where false_positives > 0"


@query("fp_rate_by_rule", sql(_RULE_RATES, "flags"))
def fp_rate_by_rule(spark, root):
    out = feedback.fp_rate_by_rule(tb.flags(spark, root), FLAGS_AS_OF, 60)
    return out.withColumn("fp_rate", F.round("fp_rate", 6))


_SIGMA_SQL = (
    "select 'amount_outlier' as rule, 2.5::double as old_sigma, count(*) filter (fp_rate > 0.5 and contains(rule, 'amount_outlier')) "
    "as matching_rules, (2.5 + 0.5 * count(*) filter (fp_rate > 0.5 and contains(rule, 'amount_outlier')))::double as new_sigma "
    f"from ({_RULE_RATES})"
)


@query("sigma_adjustments", sql(_SIGMA_SQL, "flags"))
def sigma_adjustments(spark, root):
    return feedback.sigma_adjustments(feedback.fp_rate_by_rule(tb.flags(spark, root), FLAGS_AS_OF, 60), 2.5)


def _changes(spark, root):
    flags = tb.flags(spark, root)
    listed = spark.createDataFrame([("3",)], "vendor_id string")
    chosen = feedback.vendors_to_whitelist(feedback.fp_rate_by_vendor(flags, FLAGS_AS_OF, 60), listed, 0.6)
    sigma = feedback.sigma_adjustments(feedback.fp_rate_by_rule(flags, FLAGS_AS_OF, 60), 2.5)
    return chosen, feedback.rule_changes(chosen, sigma, FLAGS_AS_OF)


@query(
    "rule_changes",
    sql(
        f"select 'whitelist_vendor' as action, 'whitelist:' || vendor_id as rule, 'true' as value from (select vendor_id, {_RATE} "
        f"from flags where {_RECENT} and vendor_id is not null group by vendor_id) where fp_rate > 0.6 and vendor_id <> '3' "
        f"union all select 'adjust_threshold', 'amount_outlier.sigma', printf('%.1f', new_sigma) from ({_SIGMA_SQL}) "
        "where new_sigma <> old_sigma",
        "flags",
    ),
)
def rule_changes(spark, root):
    _, changes = _changes(spark, root)
    now = feedback.current_rules(changes).select("rule", "value")
    return changes.select("action", "rule").join(now, "rule").select("action", "rule", "value")


@query(
    "mark_entities_whitelisted",
    sql(
        f"with w as (select vendor_id from (select vendor_id, {_RATE} from flags where {_RECENT} and vendor_id is not null "
        "group by vendor_id) where fp_rate > 0.6 and vendor_id <> '3') select cast(s_suppkey as varchar) as entity_id, "
        "cast(s_suppkey as varchar) in (select vendor_id from w) as whitelisted from supplier",
        "flags",
    ),
)
def mark_entities_whitelisted(spark, root):
    chosen, _ = _changes(spark, root)
    vendors = tb.table(spark, root, "supplier").selectExpr("cast(s_suppkey as string) as entity_id")
    return feedback.mark_entities_whitelisted(vendors, chosen)


# ---- trail, lineage, state ---------------------------------------------------------------------------


@query(
    "decision_log",
    sql(
        "select audit_run_id, row_number() over (partition by audit_run_id order by timestamp, agent_name, tool_called, "
        "execution_time_ms, input_data, output_summary) as log_sequence_number, output_summary from trail",
        "trail",
    ),
)
def decision_log(spark, root):
    out = trail.decision_log(tb.trail(spark, root))
    return out.select("audit_run_id", "log_sequence_number", "output_summary")


@query(
    "audit_trail",
    sql(
        "select log_sequence_number, output_summary from (select audit_run_id, row_number() over (partition by audit_run_id "
        "order by timestamp, agent_name, tool_called, execution_time_ms, input_data, output_summary) as log_sequence_number, "
        "output_summary from trail) where audit_run_id = 'run-8'",
        "trail",
    ),
)
def audit_trail(spark, root):
    out = trail.audit_trail(trail.decision_log(tb.trail(spark, root)), "run-8")
    return out.select("log_sequence_number", "output_summary")


@query(
    "decision_chains",
    sql(
        "select flag_id, concat_ws(',', case when list_contains(factors, 'incomplete_data') then 'DataQuality/incomplete_data' end, "
        "case when list_contains(factors, 'high_anomaly_score') then 'AnomalyDetection/high_anomaly_score' end, "
        "case when list_contains(factors, 'amount_outlier') then 'Other/amount_outlier' end, 'Escalation/' || severity_level) "
        "as decision_chain from flags",
        "flags",
    ),
)
def decision_chains(spark, root):
    out = trail.decision_chains(tb.flags(spark, root))
    text = F.transform("decision_chain", lambda e: F.concat(e["agent"], F.lit("/"), e["finding"]))
    return out.select("flag_id", F.array_join(text, ",").alias("decision_chain"))


@query(
    "lineage",
    sql(
        "select txn_id, 'raw:credit_card/' || txn_id as from_node, 'gold:' || txn_id as to_node, 'loaded_as' as relation from cards "
        f"union all select source_1_id, 'gold:' || source_1_id, 'gold:' || source_2_id, 'matched_to' from ({CANDIDATES_SQL}) "
        "union all select transaction_id, 'gold:' || transaction_id, 'signal:' || f || '/' || transaction_id, 'found' from "
        "(select *, unnest(factors) as f from flags) union all select transaction_id, 'signal:' || f || '/' || transaction_id, "
        "'flag:' || flag_id, 'led_to' from (select *, unnest(factors) as f from flags)",
        "cards",
        "bank",
        "flags",
    ),
)
def lineage(spark, root):
    cards, bank = tb.cards(spark, root), tb.bank(spark, root)
    return trail.lineage(cards, reconcile.match_candidates(cards, bank), tb.flags(spark, root))


_LINEAGE_CTES = (
    "edges as materialized (select 'raw:credit_card/' || txn_id as x, 'gold:' || txn_id as y from cards "
    "union all select 'raw:bank/' || txn_id, 'gold:' || txn_id from bank "
    "union all select 'gold:' || source_1_id, 'gold:' || source_2_id from pairs "
    "union all select 'gold:' || transaction_id, 'signal:' || f || '/' || transaction_id from (select *, unnest(factors) as f from flags) "
    "union all select 'signal:' || f || '/' || transaction_id, 'flag:' || flag_id from (select *, unnest(factors) as f from flags))"
)


def _lineage_sql(start: str, here: str, there: str) -> str:
    """DuckDB's recursion over the edges, and the least depth of each node."""
    walk = (
        f"walk as (select start, start as node, 0 as depth from ({start}) union select w.start, e.{there}, w.depth + 1 from walk w "
        f"join edges e on e.{here} = w.node where w.depth < 12)"
    )
    body = f"{_matching_oracle()}, {_LINEAGE_CTES}, {walk} select start, node, min(depth)::int as depth from walk where depth > 0 group by 1, 2"
    text = sql(f"with {body}", "cards", "bank", "flags")
    return "with recursive " + text[5:]


def _matched_lineage(spark, root):
    """Edges of cards and bank rows with the one-to-one pairs."""
    cards, bank = tb.cards(spark, root), tb.bank(spark, root)
    return trail.lineage(cards.unionByName(bank), matching.match_one_to_one(cards, bank), tb.flags(spark, root))


@query("lineage_ancestors", _lineage_sql("select 'flag:' || flag_id as start from flags", "y", "x"))
def lineage_ancestors(spark, root):
    """From every flag back to the raw rows."""
    starts = tb.flags(spark, root).select(F.concat(F.lit("flag:"), F.col("flag_id")).alias("node"))
    return trail.ancestors(_matched_lineage(spark, root), starts)


@query("lineage_descendants", _lineage_sql("select 'raw:credit_card/' || txn_id as start from cards", "x", "y"))
def lineage_descendants(spark, root):
    """From every raw card row on to matches, findings and flags."""
    starts = tb.cards(spark, root).select(F.concat(F.lit("raw:credit_card/"), F.col("txn_id")).alias("node"))
    return trail.descendants(_matched_lineage(spark, root), starts)


@query(
    "latest_state",
    sql(
        "select audit_run_id, workflow_status, event_id from (select *, row_number() over (partition by audit_run_id "
        "order by updated_at desc, event_id desc) as r from workflow_state where updated_at between "
        "timestamp '2024-01-30' - to_hours(24) and timestamp '2024-01-30') where r = 1",
        "workflow_state",
    ),
)
def latest_state(spark, root):
    out = trail.latest_state(tb.workflow_state(spark, root), TRAIL_AS_OF)
    return out.select("audit_run_id", "workflow_status", "event_id")


def _prices(spark):
    return spark.createDataFrame([("small", 0.8), ("large", 3.0)], "llm_model string, dollars_per_million double")


@query(
    "cost_report",
    sql(
        "select llm_model, agent_name, count(*) as calls, sum(llm_tokens_used)::bigint as tokens, round(sum(llm_tokens_used) * "
        "case llm_model when 'small' then 0.8 when 'large' then 3.0 else 0.15 end / 1000000.0, 6)::double as cost_dollars "
        "from trail where llm_model is not null group by llm_model, agent_name",
        "trail",
    ),
)
def cost_report(spark, root):
    out = trail.cost_report(tb.trail(spark, root), _prices(spark), 0.15)
    return out.withColumn("cost_dollars", F.round("cost_dollars", 6))


# ---- evaluation --------------------------------------------------------------------------------------


def _evaluation(spark, root):
    """Text rule against labels, one data set per language: long documents are taken for toxic ones."""
    docs = tb.table(spark, root, "documents").select("doc_id", "lang", "n_chars")
    data = docs.join(tb.table(spark, root, "labels"), "doc_id")
    named = data.select(
        F.col("lang").alias("dataset_name"), F.col("doc_id").cast("string").alias("txn_id"), "n_chars", "toxic", "quality"
    )
    totals = named.groupBy("dataset_name").agg(F.count("*").alias("total_rows"))
    return named.filter("n_chars > 900"), named.filter("toxic = 1"), totals


_EVAL_SQL = """m as (select lang as dataset_name, count(*) filter (n_chars > 900 and toxic = 1) as tp,
    count(*) filter (n_chars > 900 and toxic <> 1) as fp, count(*) filter (n_chars <= 900 and toxic <> 1) as tn,
    count(*) filter (n_chars <= 900 and toxic = 1) as fn from documents join labels using (doc_id) group by lang),
  c as (select *, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from m),
  x as (select *, case when p + r > 0 then 2 * p * r / (p + r) end as f1, tp + fn > 0 as defined from c)"""


@query(
    "confusion_matrix",
    f"with {_EVAL_SQL} select dataset_name, tp, fp, tn, fn, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1_score, "
    "round((tp + tn) / (tp + fp + tn + fn)::double, 6) as accuracy, defined as metrics_defined from x",
)
def confusion_matrix(spark, root):
    out = evaluate.confusion_matrix(*_evaluation(spark, root))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score", "accuracy")})


@query(
    "dataset_verdicts",
    f"with {_EVAL_SQL} select dataset_name, case when defined then coalesce(f1 >= 0.8, false) end as passed, "
    "coalesce(defined and r < 0.8, false) as improve_detection, coalesce(defined and p < 0.8, false) as reduce_false_positives from x",
)
def dataset_verdicts(spark, root):
    return evaluate.dataset_verdicts(evaluate.confusion_matrix(*_evaluation(spark, root)))


@query(
    "benchmark_summary",
    f"with {_EVAL_SQL} select count(*) filter (defined) as scored_datasets, count(*) filter (not defined) as skipped_datasets, "
    "round(avg(p) filter (defined), 6) as avg_precision, round(avg(r) filter (defined), 6) as avg_recall, "
    "round(avg(f1) filter (defined), 6) as avg_f1, "
    "(select dataset_name from x where defined and f1 is not null order by f1 desc, dataset_name desc limit 1) as best_dataset, "
    "(select dataset_name from x where defined and f1 is not null order by f1, dataset_name limit 1) as worst_dataset, "
    "coalesce(bool_and(coalesce(f1 >= 0.8, false)) filter (defined), true) as all_passed from x",
)
def benchmark_summary(spark, root):
    out = evaluate.benchmark_summary(evaluate.confusion_matrix(*_evaluation(spark, root)))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_precision", "avg_recall", "avg_f1")})


@query("severity_breakdown", sql("select severity_level, count(*) as flags from flags group by 1", "flags"))
def severity_breakdown(spark, root):
    return evaluate.severity_breakdown(tb.flags(spark, root))


@query(
    "expected_range_check",
    f"with {_EVAL_SQL} select dataset_name, tp + fp as flags_created, 20 as flags_created_min, 60 as flags_created_max, "
    "tp + fp between 20 and 60 as in_range from x",
)
def expected_range_check(spark, root):
    flagged, _, totals = _evaluation(spark, root)
    ranges = totals.select("dataset_name", F.lit(20).alias("flags_created_min"), F.lit(60).alias("flags_created_max"))
    return evaluate.expected_range_check(flagged, ranges)


# ---- corruption --------------------------------------------------------------------------------------

_KIND = "(('0x' || substr(md5('42|kind|' || expense_id), 1, 8))::ubigint / 4294967296.0)"
_MISSING_SQL = f"""
  sizes as (select floor(count(*) * 0.15 + 1e-9)::bigint as quota, count(distinct category) as c from card_expenses),
  a as (select expense_id, row_number() over (partition by category order by md5('42|missing|' || expense_id), expense_id)
    <= (select quota // c from sizes) as first from card_expenses),
  b as (select expense_id, row_number() over (order by md5('42|fill|' || expense_id), expense_id) as k from a where not first),
  picked as (select expense_id from a where first union all select expense_id from b
    where k <= (select quota from sizes) - (select count(*) from a where first)),
  truth as (select expense_id, case when {_KIND} < 0.5 then 'merchant' when {_KIND} < 0.8 then 'amount'
    else 'merchant,expense_date' end as detail from picked)
"""


@query(
    "corrupt_missing",
    sql(
        f"with {_MISSING_SQL} select expense_id, case when detail is null or detail = 'amount' then merchant end as merchant, "
        "case when detail is null or detail <> 'amount' then amount end as amount, "
        "case when detail is null or detail <> 'merchant,expense_date' then strftime(expense_date, '%Y-%m-%d') end as expense_date "
        "from card_expenses left join truth using (expense_id)",
        "card_expenses",
    ),
)
def corrupt_missing(spark, root):
    out = corrupt.corrupt_missing(tb.card_expenses(spark, root)).data
    return out.select("expense_id", "merchant", "amount", day("expense_date"))


@query(
    "ground_truth_of",
    sql(f"with {_MISSING_SQL} select expense_id as txn_id, detail from truth", "card_expenses"),
)
def ground_truth_of(spark, root):
    return corrupt.corrupt_missing(tb.card_expenses(spark, root)).truth


def _unit(purpose: str) -> str:
    return f"(('0x' || substr(md5('42|{purpose}|' || expense_id || '|' || no), 1, 8))::ubigint / 4294967296.0)"


@query(
    "corrupt_duplicates",
    sql(
        "with p as (select *, row_number() over (order by md5('42|duplicate|' || expense_id), expense_id) as k, "
        "case when ('0x' || substr(md5('42|copies|' || expense_id), 1, 8))::ubigint / 4294967296.0 < 0.5 then 2 else 3 end as copies "
        "from card_expenses), d as (select *, unnest(generate_series(1, copies)) as no from p "
        "where k <= (select floor(count(*) * 0.10 + 1e-9) from card_expenses)) "
        "select expense_id, merchant, amount from card_expenses union all select expense_id, merchant, "
        f"case when {_unit('near')} >= 0.5 then greatest(0, round(amount + {_unit('shift')} * 10 - 5, 2)) else amount end from d",
        "card_expenses",
    ),
)
def corrupt_duplicates(spark, root):
    return corrupt.corrupt_duplicates(tb.card_expenses(spark, root)).data.select("expense_id", "merchant", "amount")


@query("corrupt_orphans")
def corrupt_orphans(spark, root):
    cards, bank, truth = corrupt.corrupt_orphans(tb.card_expenses(spark, root), tb.bank(spark, root))
    summary = corrupt.ground_truth_of("orphans", "orphans", cards, truth)
    return summary.withColumn("bank_rows", bank.agg(F.count("*")).scalar())


# ---- monitoring --------------------------------------------------------------------------------------

_STEP_BUCKETS = DURATION_BUCKETS["step"]


@query(
    "duration_histogram",
    sql(
        "with b as (select unnest([5.0, 15.0, 30.0, 60.0, 120.0, 300.0, null])::double as le) select agent_name, le, "
        "count(*) filter (le is null or execution_time_ms / 1000.0 <= le) as cumulative, count(*) as count, "
        "round(sum(execution_time_ms) / 1000.0, 2)::double as sum from trail, b group by agent_name, le",
        "trail",
    ),
)
def duration_histogram(spark, root):
    d = tb.trail(spark, root).select("agent_name", (F.col("execution_time_ms") / 1000).alias("seconds"))
    out = monitor.duration_histogram(d, _STEP_BUCKETS, by="agent_name")
    return out.withColumn("sum", F.round("sum", 2))


@query(
    "review_queue",
    sql(
        "select severity_level, count(*) filter (not reviewed) as pending, round(avg((epoch_us(timestamp '2000-06-15 12:00:00') - "
        "epoch_us(created_at)) / 3600000000.0) filter (not reviewed), 4) as mean_age_hours, count(*) filter (reviewed and "
        "cast(review_timestamp as date) = date '2000-06-15') as reviewed_today, round(avg((epoch_us(review_timestamp) - "
        "epoch_us(created_at)) / 1000000.0) filter (reviewed), 4) as mean_review_seconds from flags "
        "where created_at <= timestamp '2000-06-15 12:00:00' group by severity_level",
        "flags",
    ),
)
def review_queue(spark, root):
    out = monitor.review_queue(tb.flags(spark, root), FLAGS_AS_OF)
    return out.withColumns({c: F.round(c, 4) for c in ("mean_age_hours", "mean_review_seconds")})


def _runs(spark, root):
    """Orders as audit runs."""
    return tb.table(spark, root, "orders").selectExpr(
        "'run-' || o_orderkey as audit_run_id",
        "case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'in_progress' else 'failed' end as workflow_status",
        "cast(o_orderdate as timestamp) as finished_at",
        "cast(o_orderkey % 600 as double) as duration_seconds",
        "cast(o_custkey as bigint) as transactions",
        "cast(o_orderkey % 100 as double) as cost_dollars",
    )


_FP = (
    "(select round(count(*) filter (reviewed and human_decision = 'false_positive') / nullif(count(*) filter (reviewed), 0)::double, 6) "
    "from flags where created_at > timestamp '2000-06-15 12:00:00' - to_days({a}) and created_at <= timestamp '2000-06-15 12:00:00' - to_days({b}))"
)


@query(
    "audit_overview",
    sql(
        "with r as (select *, o_orderkey % 600 as d from orders where o_orderdate > timestamp '2000-06-14 12:00:00' "
        "and o_orderdate <= timestamp '2000-06-15 12:00:00'), f as (select * from flags where created_at > timestamp '2000-06-14 12:00:00' "
        "and created_at <= timestamp '2000-06-15 12:00:00') select count(*) as audits, count(*) filter (o_orderstatus = 'F') as completed, "
        "round(avg(d) filter (o_orderstatus = 'F'), 4) as mean_duration_seconds, coalesce(sum(o_custkey), 0)::bigint as transactions, "
        "coalesce(sum(o_orderkey % 100), 0)::double as cost_dollars, (select count(*) from f) as flags, "
        "(select count(*) from f where severity_level = 'CRITICAL') as critical, (select count(*) from f where severity_level = 'WARNING') "
        "as warning, (select count(*) from f where severity_level = 'INFO') as info, "
        f"{_FP.format(a=7, b=0)} as fp_rate, {_FP.format(a=14, b=7)} as fp_rate_week_before from r",
        "flags",
    ),
)
def audit_overview(spark, root):
    out = monitor.audit_overview(_runs(spark, root), tb.flags(spark, root), FLAGS_AS_OF)
    return out.withColumns(
        {
            "mean_duration_seconds": F.round("mean_duration_seconds", 4),
            "fp_rate": F.round("fp_rate", 6),
            "fp_rate_week_before": F.round("fp_rate_week_before", 6),
        }
    )


@query(
    "weekly_false_positive_rate",
    sql(
        "select strftime(week, '%Y-%m-%d') as week, round(r, 6) as fp_rate, round(lag(r) over (order by week), 6) as previous_fp_rate "
        "from (select date_trunc('week', created_at) as week, count(*) filter (reviewed and human_decision = 'false_positive') / "
        "nullif(count(*) filter (reviewed), 0)::double as r from flags group by 1)",
        "flags",
    ),
)
def weekly_false_positive_rate(spark, root):
    out = monitor.weekly_false_positive_rate(tb.flags(spark, root))
    return out.select(day("week"), F.round("fp_rate", 6).alias("fp_rate"), F.round("previous_fp_rate", 6).alias("previous_fp_rate"))


@query(
    "step_success",
    sql(
        "select agent_name, count(*) as runs, round(count(*) filter (error_message is null) / count(*)::double, 6) as success_rate, "
        "round(avg(execution_time_ms) / 1000, 4) as mean_seconds from trail group by agent_name",
        "trail",
    ),
)
def step_success(spark, root):
    out = monitor.step_success(tb.trail(spark, root))
    return out.withColumns({"success_rate": F.round("success_rate", 6), "mean_seconds": F.round("mean_seconds", 4)})


@query(
    "alert_hits",
    sql(
        "select 'AgentFailureSpike' as alert, agent_name as label, round(s, 6) as value from (select agent_name, "
        "count(*) filter (error_message is null) / count(*)::double as s from trail group by 1) where s < 0.90 "
        "union all select 'AuditTimeout', audit_run_id, round(d, 6) from (select audit_run_id, sum(execution_time_ms) / 1000.0 as d "
        "from trail group by 1) where d > 1800",
        "trail",
    ),
)
def alert_hits(spark, root):
    entries = tb.trail(spark, root)
    success = monitor.step_success(entries).select(
        F.lit("agent_success_rate").alias("metric"), F.col("agent_name").alias("label"), F.col("success_rate").alias("value")
    )
    durations = entries.groupBy("audit_run_id").agg((F.sum("execution_time_ms") / 1000).alias("value")).select(
        F.lit("audit_completion_time_seconds").alias("metric"), F.col("audit_run_id").alias("label"), "value"
    )
    out = monitor.alert_hits(success.unionByName(durations))
    return out.select("alert", "label", F.round("value", 6).alias("value"))


@query(
    "detector_quality",
    sql(
        "select 'high_anomaly_score' as detector, tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 6) as precision, "
        "round(tp / nullif(tp + fn, 0)::double, 6) as recall from (select count(*) filter (f and t) as tp, "
        "count(*) filter (f and not t) as fp, count(*) filter (not f and t) as fn from (select list_contains(factors, "
        "'high_anomaly_score') as f, coalesce(human_decision, '') <> 'false_positive' as t from flags where reviewed))",
        "flags",
    ),
)
def detector_quality(spark, root):
    out = monitor.detector_quality(tb.flags(spark, root))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


# ---- sinks -------------------------------------------------------------------------------------------


@query(
    "flags_table",
    sql(
        "select flag_id, transaction_id, severity_level, reviewed, strftime(updated_at, '%Y-%m-%d') as updated_at from "
        "(select *, created_at as updated_at from flags)",
        "flags",
    ),
)
def flags_table(spark, root):
    out = sinks.conform_flags(tb.flags(spark, root))
    return out.select("flag_id", "transaction_id", "severity_level", "reviewed", day("updated_at"))
