"""Readers for raw files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas


#: Name and type of the column in which a reader reports cells that do not fit their type.
REJECTS = "rejects"
_REJECT = "array<struct<field:string,value:string>>"


def _reported(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Field and text of every cell that is there and has no value of its type, from (name, text, typed)."""
    found = [F.when(text.isNotNull() & typed.isNull(), F.struct(F.lit(name).alias("field"), text.alias("value"))) for name, text, typed in pairs]
    return F.array_compact(F.array(*found)).cast(_REJECT).alias(REJECTS)


def _csv(spark: SparkSession, path: str, schema: StructType, rejects: bool) -> DataFrame:
    """A file with a header as a table. With ``rejects`` a cell that is malformed differs from a missing one: both are NULL, and
    the first is reported with its text."""
    if not rejects:
        return spark.read.schema(schema).csv(path, header=True)
    raw = spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).csv(path, header=True)
    typed = [(f.name, F.nullif(F.trim(F.col(f.name)), F.lit("")), F.col(f.name).try_cast(f.dataType)) for f in schema.fields]
    return raw.select(*[t.alias(n) for n, _, t in typed], _reported(typed))


def read_card_expenses(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return _csv(spark, path, schemas.CARD_EXPENSES, rejects)


def read_bank(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return _csv(spark, path, schemas.BANK, rejects)


def read_receipts(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return _csv(spark, path, schemas.RECEIPTS, rejects)


def read_clients(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return _csv(spark, path, schemas.CLIENTS, rejects)


def read_json_table(spark: SparkSession, path: str, schema: StructType, lines: bool = False, rejects: bool = False) -> DataFrame:
    """JSON as a table. ``lines=False`` reads array files; ``lines=True`` reads splittable JSON lines.

    With ``rejects`` documents are read as variants: the elements of an array are dealt out to all tasks before their fields are taken, fields
    that do not fit are reported with their JSON text (a text field takes any value, as its JSON), and a document that is no JSON (or no array) is one row with field ``$``.
    """
    if not rejects:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    docs = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("doc"))
    if lines:
        rows = docs.select(F.col("doc").alias("row"), F.when(F.col("doc").isNull(), F.col("value")).alias("broken"))
    else:
        elements = F.try_variant_get("doc", "$", "array<variant>")
        dealt = docs.select(F.posexplode(elements).alias("place", "row")).repartition("place")
        rows = dealt.select("row", F.lit(None).cast("string").alias("broken")).union(docs.where(elements.isNull()).select(F.lit(None).cast("variant"), "value"))
    typed = []
    for f in schema.fields:
        at = f"$['{f.name}']"
        cell = F.try_variant_get("row", at, "variant")
        text = F.when(~F.is_variant_null(cell), F.to_json(cell))
        typed.append((f.name, text, F.try_variant_get("row", at, f.dataType.simpleString())))
    whole = F.array(F.struct(F.lit("$").alias("field"), F.col("broken").alias("value"))).cast(_REJECT)
    return rows.select(*[t.alias(n) for n, _, t in typed], F.when(F.col("broken").isNotNull(), whole).otherwise(_reported(typed)).alias(REJECTS))


def emails_from_json(raw: DataFrame) -> DataFrame:
    """The mail layout the operators expect (``email_date``, ``thread_id``)."""
    thread = F.col("thread_id") if "thread_id" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "email_id", "subject", "sender", "body", thread.alias("thread_id"), F.col("date").alias("email_date")
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per data set from ``metadata.json`` files."""
    raw = spark.read.schema(schemas.GROUND_TRUTH).json(path, multiLine=True)
    return raw.select(
        "dataset_name",
        "corruption_type",
        F.col("ground_truth.total_rows").alias("total_rows"),
        F.col("ground_truth.corrupted_rows").alias("corrupted_rows"),
        F.col("ground_truth.corrupted_row_ids").alias("corrupted_row_ids"),
        F.col("ground_truth.corruption_details").alias("corruption_details"),
        F.col("expected_results.flags_created_min").alias("flags_created_min"),
        F.col("expected_results.flags_created_max").alias("flags_created_max"),
    )


def ground_truth_ids(truth: DataFrame) -> DataFrame:
    """One row per corrupted id with its detail text."""
    return truth.select("dataset_name", "corruption_details", F.explode("corrupted_row_ids").alias("txn_id")).select(
        "dataset_name", "txn_id", F.element_at("corruption_details", F.col("txn_id")).alias("detail")
    )
