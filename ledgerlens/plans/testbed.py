"""Audit tables derived from the TPC-H-like driver tables, with integer arithmetic that SQL can repeat.

Each function reads the whole table. ``sql()`` gives the same derivations as common table expressions for
DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A driver table. A small one is one file with one row group, which is one task: such a table is spread over the
    cores first. Tables that Spark reads in enough pieces by itself, being large or of many files, are read as they are."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) else df


def _supplied(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "cast(l_quantity as bigint) as q",
        "cast(round(l_extendedprice * 100) as bigint) div 20 as cents",
        "l_tax",
        "l_linestatus",
        "l_shipdate",
    )
    names = table(spark, root, "supplier").select("s_suppkey", "s_name")
    return items.join(names, F.col("l_suppkey") == F.col("s_suppkey"))


_UNIQUE = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || q"
_VENDOR = "case when l_orderkey % 20 <> 0 then s_name end"
_AMOUNT = "case when l_orderkey % 33 <> 0 then cents / 100.0D end"
_DATE = "case when l_orderkey % 50 <> 0 then l_shipdate end"


def cards(spark: SparkSession, root: str, repeated_ids: bool = False) -> DataFrame:
    """Gold card rows with missing values; ``repeated_ids`` uses the natural duplicates of order and line."""
    txn_id = "'ORD_' || l_orderkey || '_' || l_linenumber" if repeated_ids else f"'EXP_' || {_UNIQUE}"
    return _supplied(spark, root).selectExpr(
        f"{txn_id} as txn_id",
        "'credit_card' as source",
        f"cast({_AMOUNT} as double) as amount",
        f"{_VENDOR} as vendor",
        "cast(l_suppkey as string) as vendor_id",
        f"cast({_DATE} as timestamp) as date",
    )


def bank(spark: SparkSession, root: str) -> DataFrame:
    """Gold bank rows: the taxed card rows, amount shifted by -4..+8 percent, date by -1..+4 days."""
    return _supplied(spark, root).filter("l_tax > 0").selectExpr(
        f"'BNK_' || {_UNIQUE} as txn_id",
        "'bank' as source",
        "cast((cents * (100 + (l_linenumber - 3) * 2)) div 100 / 100.0D as double) as amount",
        f"{_VENDOR} as vendor",
        "cast(l_suppkey as string) as vendor_id",
        "cast(l_shipdate + make_dt_interval(cast(l_orderkey % 6 - 1 as int)) as timestamp) as date",
    )


def receipts(spark: SparkSession, root: str) -> DataFrame:
    """Gold receipts for the open lines, up to eight days after the payment."""
    return _supplied(spark, root).filter("l_linestatus = 'O'").selectExpr(
        f"'RCP_' || {_UNIQUE} as txn_id",
        "'receipts' as source",
        f"cast({_AMOUNT} as double) as amount",
        "s_name as vendor",
        "cast(l_suppkey as string) as vendor_id",
        "cast(l_shipdate + make_dt_interval(cast(l_orderkey % 9 as int)) as timestamp) as date",
    )


def receipts_ocr(spark: SparkSession, root: str) -> DataFrame:
    return receipts(spark, root).selectExpr(
        "txn_id as receipt_id",
        "'receipts/' || txn_id || '.jpg' as file_path",
        "'INV ' || vendor || ' LTD' as ocr_vendor",
        "amount as ocr_amount",
        "cast(date as date) as ocr_date",
    )


def card_expenses(spark: SparkSession, root: str) -> DataFrame:
    """Raw card layout without missing values."""
    return _supplied(spark, root).selectExpr(
        f"'EXP_' || {_UNIQUE} as expense_id",
        "cast(l_shipdate as date) as expense_date",
        "cast(l_partkey % 50 as string) as cardholder_id",
        "'Holder ' || l_partkey % 50 as cardholder_name",
        "'standard' as card_program",
        "cast(1000 + l_partkey % 50 as string) as card_last4",
        "'cat' || l_linenumber as category",
        "s_name as merchant",
        "cast(cents / 100.0D as double) as amount",
        "cast(200 as int) as client_count_at_time",
    )


def bank_raw(spark: SparkSession, root: str) -> DataFrame:
    return bank(spark, root).selectExpr(
        "vendor_id as bank_account_id",
        "cast(date as date) as transaction_date",
        "coalesce(vendor, 'unknown') as description",
        "'debit' as type",
        "-amount as amount",
        "0.0D as running_balance",
    )


def emails(spark: SparkSession, root: str) -> DataFrame:
    """Conversations as mails: every third thread has an approval in its third turn, some subjects and bodies
    name a supplier."""
    mails = table(spark, root, "conversations").withColumn("k", F.expr("conv_id % 10"))
    names = table(spark, root, "supplier").select("s_suppkey", "s_name")
    return mails.join(names, F.col("k") == F.col("s_suppkey")).selectExpr(
        "conv_id || '-' || turn as email_id",
        "case when turn % 2 = 0 then 'Invoice ' || upper(s_name) else 'Re: invoice' end as subject",
        "case when turn % 3 = 0 then text || ' ' || s_name || ' order' "
        "when conv_id % 3 = 0 and turn = 2 then text || ' approved, please pay' else text end as body",
        "role || conv_id || '@example.com' as sender",
        "cast(conv_id as string) as thread_id",
        "timestamp'1996-01-01' + make_dt_interval(cast((conv_id * 37 + turn) % 1800 as int)) as email_date",
    )


def calendar(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events").withColumn("k", F.expr("user_id % 10"))
    names = table(spark, root, "supplier").select("s_suppkey", "s_name")
    return events.join(names, F.col("k") == F.col("s_suppkey")).selectExpr(
        "cast(event_id as string) as event_id",
        "event_type || ' with ' || s_name as title",
        "props as description",
        "ts - make_dt_interval(9000) as event_date",
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").selectExpr(
        "doc_id", "source || ' ' || doc_id as title", "text as snippet", "text as content"
    )


def kg_entities(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").selectExpr(
        "'ent_' || s_suppkey as entity_id",
        "s_name as canonical_name",
        "array('ALIAS ' || s_name || ' INC', 'SUP-' || s_suppkey) as aliases",
        "case when s_nationkey % 2 = 0 then 'supplier' else 'contractor' end as entity_type",
    )


def flags(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed flags on every card row that lacks a field or costs at least 4000."""
    factors = (
        "array_compact(array(case when vendor is null or amount is null or date is null then 'incomplete_data' end, "
        "case when amount >= 4000 then 'amount_outlier' end, "
        "case when amount >= 4500 then 'high_anomaly_score' end))"
    )
    base = _supplied(spark, root).selectExpr(
        f"'EXP_' || {_UNIQUE} as transaction_id",
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        f"{_VENDOR} as vendor",
        "cast(l_suppkey as string) as vendor_id",
        f"cast({_AMOUNT} as double) as amount",
        f"{_DATE} as date",
    )
    return base.selectExpr("*", f"{factors} as factors").filter("size(factors) > 0").selectExpr(
        "'F' || transaction_id as flag_id",
        "transaction_id",
        "'run-' || l_orderkey % 20 as audit_run_id",
        "case when amount >= 4500 then 'CRITICAL' when amount >= 4000 then 'WARNING' else 'INFO' end as severity_level",
        "factors",
        "l_linenumber <= 5 as reviewed",
        "case when l_linenumber = 1 then 'approved' when l_linenumber <= 5 then 'false_positive' end as human_decision",
        "case when l_linenumber <= 5 then cast(l_shipdate + make_dt_interval(0, cast(l_orderkey % 48 as int)) as timestamp) end "
        "as review_timestamp",
        "cast(l_shipdate as timestamp) as created_at",
        "vendor_id",
        "vendor",
        "amount",
    )


def trail(spark: SparkSession, root: str) -> DataFrame:
    """Audit trail entries from the event stream: users are runs, event types are steps."""
    return table(spark, root, "events").selectExpr(
        "'run-' || user_id as audit_run_id",
        "ts as timestamp",
        "event_type as agent_name",
        "'tool_' || event_type as tool_called",
        "cast(round(value * 100) as bigint) * 10 as execution_time_ms",
        "props as input_data",
        "cast(event_id as string) as output_summary",
        "case when event_id % 4 = 0 then 'small' when event_id % 4 = 1 then 'large' when event_id % 4 = 2 then 'other' end as llm_model",
        "event_id % 5000 as llm_tokens_used",
        "case when event_id % 17 = 0 then 'failed' end as error_message",
    )


def workflow_state(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").selectExpr(
        "'run-' || user_id as audit_run_id",
        "case when event_type = 'purchase' then 'completed' when event_type = 'error' then 'failed' else 'in_progress' end "
        "as workflow_status",
        "event_type as current_agent",
        "ts as created_at",
        "ts as updated_at",
        "event_id",
    )


_CTES = {
    "supplied": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, "
    "cast(round(l_extendedprice * 100) as bigint) // 20 as cents, l_tax, l_linestatus, "
    "l_shipdate, s_name "
    "from lineitem join supplier on l_suppkey = s_suppkey",
    "cards": f"select 'EXP_' || {_UNIQUE} as txn_id, 'credit_card' as source, "
    "case when l_orderkey % 33 <> 0 then cents / 100.0::double end as amount, "
    "case when l_orderkey % 20 <> 0 then s_name end as vendor, cast(l_suppkey as varchar) as vendor_id, "
    "case when l_orderkey % 50 <> 0 then l_shipdate end as date from supplied",
    "cards_rep": "select 'ORD_' || l_orderkey || '_' || l_linenumber as txn_id, 'credit_card' as source, "
    "case when l_orderkey % 33 <> 0 then cents / 100.0::double end as amount, "
    "case when l_orderkey % 20 <> 0 then s_name end as vendor, cast(l_suppkey as varchar) as vendor_id, "
    "case when l_orderkey % 50 <> 0 then l_shipdate end as date from supplied",
    "bank": f"select 'BNK_' || {_UNIQUE} as txn_id, 'bank' as source, "
    "((cents * (100 + (l_linenumber - 3) * 2)) // 100) / 100.0::double as amount, "
    "case when l_orderkey % 20 <> 0 then s_name end as vendor, cast(l_suppkey as varchar) as vendor_id, "
    "l_shipdate + to_days(cast(l_orderkey % 6 - 1 as integer)) as date from supplied where l_tax > 0",
    "receipts": f"select 'RCP_' || {_UNIQUE} as txn_id, 'receipts' as source, "
    "case when l_orderkey % 33 <> 0 then cents / 100.0::double end as amount, s_name as vendor, "
    "cast(l_suppkey as varchar) as vendor_id, "
    "l_shipdate + to_days(cast(l_orderkey % 9 as integer)) as date from supplied where l_linestatus = 'O'",
    "receipts_ocr": "select txn_id as receipt_id, 'receipts/' || txn_id || '.jpg' as file_path, "
    "'INV ' || vendor || ' LTD' as ocr_vendor, amount as ocr_amount, cast(date as date) as ocr_date from receipts",
    "card_expenses": f"select 'EXP_' || {_UNIQUE} as expense_id, cast(l_shipdate as date) as expense_date, "
    "cast(l_partkey % 50 as varchar) as cardholder_id, 'Holder ' || l_partkey % 50 as cardholder_name, "
    "'standard' as card_program, cast(1000 + l_partkey % 50 as varchar) as card_last4, "
    "'cat' || l_linenumber as category, s_name as merchant, cents / 100.0::double as amount, "
    "200 as client_count_at_time from supplied",
    "bank_raw": "select vendor_id as bank_account_id, cast(date as date) as transaction_date, "
    "coalesce(vendor, 'unknown') as description, 'debit' as type, -amount as amount, 0.0::double as running_balance "
    "from bank",
    "emails": "select conv_id || '-' || turn as email_id, "
    "case when turn % 2 = 0 then 'Invoice ' || upper(s_name) else 'Re: invoice' end as subject, "
    "case when turn % 3 = 0 then text || ' ' || s_name || ' order' "
    "when conv_id % 3 = 0 and turn = 2 then text || ' approved, please pay' else text end as body, "
    "role || conv_id || '@example.com' as sender, cast(conv_id as varchar) as thread_id, "
    "timestamp '1996-01-01' + to_days(cast((conv_id * 37 + turn) % 1800 as integer)) as email_date "
    "from conversations join supplier on conv_id % 10 = s_suppkey",
    "calendar": "select cast(event_id as varchar) as event_id, event_type || ' with ' || s_name as title, "
    "props as description, ts - to_days(9000) as event_date from events join supplier on user_id % 10 = s_suppkey",
    "docs": "select doc_id, source || ' ' || doc_id as title, text as snippet, text as content from documents",
    "kg": "select 'ent_' || s_suppkey as entity_id, s_name as canonical_name, "
    "['ALIAS ' || s_name || ' INC', 'SUP-' || s_suppkey] as aliases, "
    "case when s_nationkey % 2 = 0 then 'supplier' else 'contractor' end as entity_type from supplier",
    "flags": f"""select 'FEXP_' || {_UNIQUE} as flag_id, 'EXP_' || {_UNIQUE} as transaction_id,
        'run-' || l_orderkey % 20 as audit_run_id,
        case when amount >= 4500 then 'CRITICAL' when amount >= 4000 then 'WARNING' else 'INFO' end as severity_level,
        factors, l_linenumber <= 5 as reviewed,
        case when l_linenumber = 1 then 'approved' when l_linenumber <= 5 then 'false_positive' end as human_decision,
        case when l_linenumber <= 5 then l_shipdate + to_hours(l_orderkey % 48) end as review_timestamp,
        l_shipdate as created_at, vendor_id, vendor, amount
      from (select *, list_concat(list_concat(
          case when vendor is null or amount is null or date is null then ['incomplete_data'] else [] end,
          case when amount >= 4000 then ['amount_outlier'] else [] end),
          case when amount >= 4500 then ['high_anomaly_score'] else [] end) as factors
        from (select *, case when l_orderkey % 33 <> 0 then cents / 100.0::double end as amount,
          case when l_orderkey % 20 <> 0 then s_name end as vendor, cast(l_suppkey as varchar) as vendor_id,
          case when l_orderkey % 50 <> 0 then l_shipdate end as date from supplied))
      where len(factors) > 0""",
    "trail": "select 'run-' || user_id as audit_run_id, ts as timestamp, event_type as agent_name, "
    "'tool_' || event_type as tool_called, cast(round(value * 100) as bigint) * 10 as execution_time_ms, "
    "props as input_data, cast(event_id as varchar) as output_summary, "
    "case when event_id % 4 = 0 then 'small' when event_id % 4 = 1 then 'large' when event_id % 4 = 2 then 'other' end "
    "as llm_model, event_id % 5000 as llm_tokens_used, case when event_id % 17 = 0 then 'failed' end as error_message "
    "from events",
    "workflow_state": "select 'run-' || user_id as audit_run_id, case when event_type = 'purchase' then 'completed' "
    "when event_type = 'error' then 'failed' else 'in_progress' end as workflow_status, event_type as current_agent, "
    "ts as created_at, ts as updated_at, event_id from events",
}
_NEEDS = {
    "cards": ["supplied"],
    "cards_rep": ["supplied"],
    "bank": ["supplied"],
    "receipts": ["supplied"],
    "receipts_ocr": ["supplied", "receipts"],
    "card_expenses": ["supplied"],
    "bank_raw": ["supplied", "bank"],
    "flags": ["supplied"],
}


def sql(query: str, *tables: str) -> str:
    """``query`` with the derivations of ``tables`` in front of it."""
    wanted: list[str] = []
    for t in tables:
        for name in [*_NEEDS.get(t, []), t]:
            if name not in wanted:
                wanted.append(name)
    ctes = ", ".join(f"{name} as ({_CTES[name]})" for name in wanted)
    body = query.strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}" if ctes else body
