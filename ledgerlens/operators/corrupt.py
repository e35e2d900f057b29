"""Corruption jobs: clean tables in, corrupted tables and their ground truth out.

Choices come from hashes of the seed and the row's id, so a job repeats exactly on any cluster. Sizes are
exact: rows are counted by the first digits of the hash, and only those around the limit are ranked. Expense ids must be
unique in the clean table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from ..functions.columns import hash_fraction
from ..functions.skew import join_unique, number_rows

# Fixed values of the phantom rows.
PHANTOM_VENDORS = (
    "AWS Cloud Services",
    "Slack Technologies",
    "Zoom Video",
    "Cash Withdrawal - ATM",
    "Unknown Merchant",
    "Suspicious Vendor LLC",
    "Crypto Exchange",
)
PHANTOM_CATEGORIES = ("Software & Subscriptions", "Travel & Entertainment", "Miscellaneous")


class Corrupted(NamedTuple):
    data: DataFrame
    truth: DataFrame  # txn_id, detail


def _fraction(seed: int, purpose: str, *parts: Column) -> Column:
    return hash_fraction(F.lit(seed), F.lit(purpose), *parts)


def _chosen(seed: int, purpose: str, ids: DataFrame, keys: list[str], quota: Column) -> DataFrame:
    """ids (with keys, which are not NULL) and whether they are among the first ``quota`` of their key by hash.

    Rows are counted by the first digits of the hash; that settles all but those of one value for each key, and only these are ranked.
    """
    hashed = ids.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.lit(purpose), F.col("expense_id"))))
    hashed = hashed.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("_b"))
    counted = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("n")).withColumn("upto", upto)
    edge = F.min(F.when(F.col("upto") > quota, F.struct("_b", (quota - F.col("upto") + F.col("n")).alias("need")))).alias("e")
    edges = cut(counted.groupBy(*keys).agg(edge).select(*keys, F.coalesce("e._b", F.lit(4096)).alias("edge"), F.coalesce("e.need", F.lit(0)).alias("need")))
    marked = hashed.join(edges, keys) if keys else hashed.crossJoin(F.broadcast(edges))
    sure = marked.where("_b <> edge").select(*keys, "expense_id", (F.col("_b") < F.col("edge")).alias("picked"))
    close = cut(marked.where("_b = edge").select(*keys, "need", "_h", "expense_id"))
    ranked = number_rows(close, [*keys, "need"], ["_h", "expense_id"], "rank")
    return sure.unionByName(cut(ranked.select(*keys, "expense_id", (F.col("rank") <= F.col("need")).alias("picked"))))


def corrupt_missing(cards: DataFrame, rate: float = 0.15, seed: int = 42) -> Corrupted:
    """Null required fields in int(rows * rate) rows, spread evenly over categories as far as they reach."""
    ids = cards.select(F.coalesce("category", F.lit("")).alias("category"), "expense_id")
    size = cut(ids.agg(F.count("*").alias("n"), F.count_distinct("category").alias("c")).select(
        F.floor(F.col("n") * F.lit(rate) + F.lit(1e-9)).alias("quota"), "c"
    ))
    quota, categories = size.select("quota").scalar(), size.select("c").scalar()
    share = F.coalesce(F.floor(F.try_divide(quota, categories)), F.lit(0))
    marked = cut(_chosen(seed, "missing", ids, ["category"], share))
    first = marked.filter("picked").select("expense_id")
    missing_n = quota - first.agg(F.count("*")).scalar()
    rest = _chosen(seed, "fill", marked.filter("NOT picked").select("expense_id"), [], missing_n)
    picked = first.unionByName(rest.filter("picked").select("expense_id"))
    kind = _fraction(seed, "kind", F.col("expense_id"))
    picked = picked.withColumn(
        "nulled", F.when(kind < 0.5, F.lit("merchant")).when(kind < 0.8, F.lit("amount")).otherwise(F.lit("merchant,expense_date"))
    )
    picked = cut(picked)
    joined = join_unique(cards, picked, ["expense_id"])
    data = joined.withColumns(
        {
            "merchant": F.when(~F.coalesce(F.contains("nulled", F.lit("merchant")), F.lit(False)), F.col("merchant")),
            "amount": F.when(~F.coalesce(F.col("nulled") == "amount", F.lit(False)), F.col("amount")),
            "expense_date": F.when(
                ~F.coalesce(F.contains("nulled", F.lit("expense_date")), F.lit(False)), F.col("expense_date")
            ),
        }
    ).select(*cards.columns)
    return Corrupted(data, picked.select(F.col("expense_id").alias("txn_id"), F.col("nulled").alias("detail")))


def corrupt_duplicates(cards: DataFrame, rate: float = 0.10, seed: int = 42) -> Corrupted:
    """Add two or three copies of int(rows * rate) rows, about half of them with the amount off by up to 5."""
    quota = cards.agg(F.floor(F.count("*") * F.lit(rate) + F.lit(1e-9)).alias("q")).scalar()
    chosen = _chosen(seed, "duplicate", cards.select("expense_id"), [], quota)
    extra = F.when(_fraction(seed, "copies", F.col("expense_id")) < 0.5, F.lit(2)).otherwise(F.lit(3))
    picked = cut(chosen.filter("picked").select("expense_id", extra.alias("copies")))
    copies = picked.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    near = _fraction(seed, "near", F.col("expense_id"), F.col("no")) >= 0.5
    shift = _fraction(seed, "shift", F.col("expense_id"), F.col("no")) * 10 - 5
    added = cards.join(copies, "expense_id").withColumn(
        "amount", F.when(near, F.greatest(F.lit(0.0), F.round(F.col("amount") + shift, 2))).otherwise(F.col("amount"))
    )
    kinds = copies.withColumn("near", near).groupBy("expense_id").agg(
        F.count("*").alias("c"), F.count_if("near").alias("n")
    )
    detail = F.format_string("copies=%d, near=%d", "c", "n")
    return Corrupted(
        cards.unionByName(added.select(*cards.columns)),
        kinds.select(F.col("expense_id").alias("txn_id"), detail.alias("detail")),
    )


def corrupt_orphans(
    cards: DataFrame, bank: DataFrame, new_orphans: int = 50, delete_bank: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards with phantom rows of 5-15 thousand in the last 30 days, bank without some rows, truth).

    ``bank`` carries txn_id. The phantom count and the number of deleted rows are parameters, so both sides
    of the small joins have a fixed size.
    """
    spark = cards.sparkSession
    n = F.col("n")

    def pick(purpose: str, values: tuple[str, ...]) -> Column:
        at = F.floor(_fraction(seed, purpose, n) * len(values)).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    number = F.expr("try_cast(regexp_extract(expense_id, '^EXP_([0-9]+)$', 1) as bigint)")
    top = cards.agg(F.coalesce(F.max(number), F.lit(0))).scalar()
    last = cards.agg(F.max("expense_date")).scalar()
    holder_columns = ["cardholder_id", "cardholder_name", "card_program", "card_last4"]
    hashed = F.md5(F.concat_ws("|", F.lit(seed), "cardholder_id", "card_last4"))
    holders = cards.groupBy(*holder_columns).agg(F.lit(1).alias("_")).drop("_")
    holders = holders.orderBy(hashed, *holder_columns).limit(max(new_orphans, 1))
    who = holders.agg(F.array_sort(F.collect_list(F.struct(*holder_columns)))).scalar()  # at most new_orphans entries
    phantoms = (
        spark.range(new_orphans)
        .withColumnRenamed("id", "n")
        .withColumn("w", who)
        .withColumn("w", F.get("w", F.pmod(n, F.greatest(F.size("w"), F.lit(1))).cast("int")))
        .select(
            F.concat(F.lit("EXP_"), F.lpad((top + n + 1).cast("string"), 7, "0")).alias("expense_id"),
            F.date_sub(last, (F.floor(_fraction(seed, "day", n) * 30) + 1).cast("int")).alias("expense_date"),
            "w.*",
            pick("category", PHANTOM_CATEGORIES).alias("category"),
            pick("vendor", PHANTOM_VENDORS).alias("merchant"),
            F.round(_fraction(seed, "amount", n) * 10000 + 5000, 2).alias("amount"),
            (F.floor(_fraction(seed, "clients", n) * 101) + 150).cast("int").alias("client_count_at_time"),
        )
    )
    phantoms = phantoms.select(*[F.col(f.name).cast(f.dataType) for f in cards.schema.fields])
    doomed = bank.select("txn_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("bank"), "txn_id")), "txn_id").limit(delete_bank)
    truth = phantoms.select(F.col("expense_id").alias("txn_id"), F.lit("phantom_expense").alias("detail"))
    return cards.unionByName(phantoms), bank.join(F.broadcast(doomed), "txn_id", "left_anti"), truth


def ground_truth_of(name: str, kind: str, data: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of totals for a corrupted table; the ids and details stay rows of ``truth``."""
    return truth.agg(F.count_distinct("txn_id").alias("corrupted_rows")).select(
        F.lit(name).alias("dataset_name"),
        F.lit(kind).alias("corruption_type"),
        data.agg(F.count("*")).scalar().alias("total_rows"),
        "corrupted_rows",
    )
