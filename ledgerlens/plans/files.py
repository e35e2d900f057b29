"""Readers and writers as queries: the driver tables are written as files, with broken cells among them, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.checkpoints import shared_folder
from ..operators.escalate import audit_summary
from ..sources import readers, sinks
from . import testbed as tb
from .checks import day, query
from .testbed import sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def _rejected():
    return F.array_join(F.transform(readers.REJECTS, lambda r: F.concat_ws("=", r["field"], r["value"])), ",").alias("rejects")


def _as_csv(df: DataFrame, broken: dict[str, str]) -> str:
    """``df`` as CSV files; ``broken`` replaces columns by SQL expressions over their text."""
    path = _folder(df.sparkSession, "csv")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.selectExpr(*[f"{broken[c]} as {c}" if c in broken else c for c in df.columns]).write.option("header", True).csv(path)
    return path


@query(
    "read_card_expenses",
    sql(
        "select expense_id, strftime(expense_date, '%Y-%m-%d') as expense_date, merchant, case when right(expense_id, 1) not in ('3', '7') then amount end as amount, "
        "case when right(expense_id, 1) = '7' then 'amount=n/a' else '' end as rejects from card_expenses",
        "card_expenses",
    ),
)
def read_card_expenses(spark, root):
    """Amounts that are missing and amounts that are no numbers."""
    path = _as_csv(tb.card_expenses(spark, root), {"amount": "case when right(expense_id, 1) = '7' then 'n/a' when right(expense_id, 1) <> '3' then amount end"})
    out = readers.read_card_expenses(spark, path, rejects=True)
    return out.select("expense_id", day("expense_date"), "merchant", "amount", _rejected())


@query(
    "read_bank",
    sql(
        "select bank_account_id, case when right(bank_account_id, 1) <> '5' then strftime(transaction_date, '%Y-%m-%d') end as transaction_date, description, amount, "
        "case when right(bank_account_id, 1) = '5' then 'transaction_date=31.12.' || strftime(transaction_date, '%Y') else '' end as rejects from bank_raw",
        "bank_raw",
    ),
)
def read_bank(spark, root):
    path = _as_csv(tb.bank_raw(spark, root), {"transaction_date": "case when right(bank_account_id, 1) = '5' then '31.12.' || left(transaction_date, 4) else transaction_date end"})
    out = readers.read_bank(spark, path, rejects=True)
    return out.select("bank_account_id", day("transaction_date"), "description", "amount", _rejected())


@query(
    "read_receipts",
    sql("select txn_id as receipt_id, strftime(date, '%Y-%m-%d') as receipt_date, vendor as vendor_name, amount, '' as rejects from receipts", "receipts"),
)
def read_receipts(spark, root):
    rows = tb.receipts(spark, root).select(F.col("txn_id").alias("receipt_id"), F.to_date("date").alias("receipt_date"), F.col("vendor").alias("vendor_name"), "amount")
    out = readers.read_receipts(spark, _as_csv(rows, {}), rejects=True)
    return out.select("receipt_id", day("receipt_date"), "vendor_name", "amount", _rejected())


@query(
    "read_clients",
    "select c_custkey::varchar as client_id, c_name as client_name, c_mktsegment as client_type, case when c_custkey % 10 <> 4 then c_custkey * 1000 end as aum_usd, "
    "case when c_custkey % 10 = 4 then 'aum_usd=' || c_custkey * 1000 || ' USD' else '' end as rejects from customer",
)
def read_clients(spark, root):
    rows = tb.table(spark, root, "customer").selectExpr(
        "cast(c_custkey as string) as client_id", "c_name as client_name", "c_mktsegment as client_type", "cast(c_custkey * 1000 as bigint) as aum_usd", "0.5D as advisory_fee_pct", "date'2020-01-31' as sign_on_date"
    )
    path = _as_csv(rows, {"aum_usd": "case when aum_usd div 1000 % 10 = 4 then aum_usd || ' USD' else aum_usd end"})
    return readers.read_clients(spark, path, rejects=True).select("client_id", "client_name", "client_type", "aum_usd", _rejected())


def _mails(spark, root) -> DataFrame:
    """Mails as JSON text, some with a date that is none."""
    mails = tb.emails(spark, root)
    date = F.when(F.endswith("email_id", F.lit("3")), F.lit("soon")).otherwise(F.date_format("email_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return mails.select("email_id", F.to_json(F.struct("email_id", "subject", "sender", date.alias("date"), "body", F.array("thread_id").alias("related_transactions"))).alias("value"))


_MAILS_SQL = (
    "select email_id, subject, body, case when right(email_id, 1) <> '3' then strftime(email_date, '%Y-%m-%d') end as date, thread_id as related, "
    "case when right(email_id, 1) = '3' then 'date=\"soon\"' else '' end as rejects from emails"
)


def _read_mails(spark, path, lines):
    out = readers.read_json_table(spark, path, schemas.JSON_EMAILS, lines=lines, rejects=True)
    return out.select("email_id", "subject", "body", day("date"), F.element_at("related_transactions", 1).alias("related"), _rejected())


@query("read_json_lines", sql(_MAILS_SQL + " union all select null, null, null, null, null, '$={broken'", "emails"))
def read_json_lines(spark, root):
    path = _folder(spark, "json-lines")
    _mails(spark, root).select("value").write.text(path)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return _read_mails(spark, path, True)


@query("read_json_table", sql(_MAILS_SQL, "emails"))
def read_json_table(spark, root):
    """Array files of about a hundred mails each."""
    path, mails = _folder(spark, "json-arrays"), _mails(spark, root)
    files = mails.count() // 100 + 1
    arrays = mails.groupBy(F.pmod(F.xxhash64("email_id"), F.lit(files)).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    # one array in each file
    arrays.repartition(files, "file").select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return _read_mails(spark, path, False)


# ---- writers -------------------------------------------------------------------------------------------


@query(
    "write_flags",
    sql("select flag_id, transaction_id, severity_level, array_to_string(factors, ',') as factors, reviewed, strftime(created_at, '%Y-%m-%d') as audit_date from flags", "flags"),
)
def write_flags(spark, root):
    path = _folder(spark, "flags")
    sinks.write_flags(tb.flags(spark, root), path)
    return spark.read.parquet(path).select("flag_id", "transaction_id", "severity_level", F.array_join("factors", ",").alias("factors"), "reviewed", day("audit_date"))


@query("write_audit_trail", sql("select audit_run_id, agent_name, tool_called, execution_time_ms, input_data, output_summary, llm_tokens_used, error_message from trail", "trail"))
def write_audit_trail(spark, root):
    path = _folder(spark, "trail")
    sinks.write_audit_trail(tb.trail(spark, root), path)
    rows = spark.read.schema(schemas.AUDIT_TRAIL).parquet(path)
    return rows.select("audit_run_id", "agent_name", "tool_called", "execution_time_ms", "input_data", "output_summary", "llm_tokens_used", "error_message")


@query("archive_audit_run", sql("select agent_name, output_summary from trail where audit_run_id = 'run-8'", "trail"))
def archive_audit_run(spark, root):
    path = _folder(spark, "archive")
    sinks.archive_audit_run(tb.trail(spark, root), "run-8", path)
    return spark.read.parquet(path).where("audit_run_id = 'run-8'").select("agent_name", "output_summary")


@query("write_workflow_state", sql("select audit_run_id, workflow_status, current_agent, strftime(updated_at, '%Y-%m-%d') as updated_at from workflow_state", "workflow_state"))
def write_workflow_state(spark, root):
    path = _folder(spark, "state")
    sinks.write_workflow_state(tb.workflow_state(spark, root), path)
    return spark.read.parquet(path).select("audit_run_id", "workflow_status", "current_agent", day("updated_at"))


@query(
    "write_audit_result",
    sql(
        "select 'flag' as kind, flag_id, severity_level, null::bigint as flags_created from flags union all "
        "select 'summary', null, null, count(*) from flags",
        "flags",
    ),
)
def write_audit_result(spark, root):
    path, flags = _folder(spark, "result"), tb.flags(spark, root)
    sinks.write_audit_result(audit_summary("run-1", tb.cards(spark, root), flags), flags.withColumn("audit_run_id", F.lit("run-1")), path)
    rows = spark.read.schema("audit_run_id string, body string, kind string").json(path)
    field = lambda name: F.get_json_object("body", f"$.{name}").alias(name)
    return rows.select("kind", field("flag_id"), field("severity_level"), field("flags_created").cast("long").alias("flags_created"))
