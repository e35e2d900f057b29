"""Reconciliation of two streams: candidate pairs as rows arrive, rows without a partner when none can come any more.

Rows meet in cells of (vendor name or id, sign, range of days, range of amounts), as in the batch join: bank rows go to their own cell,
card rows to every cell their tolerances reach. The cells are the keys of a full outer join of the two streams. Its state keeps a row
until no partner can come any more; then the row is forgotten, and reported if it had none. Cells, not vendors, are
the keys, so a vendor with a third of all rows is spread over its days and amounts.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bins import amount_bin, amount_bins, time_bin, time_bins
from ..functions.columns import days_apart, relative_gap
from ..operators.reconcile import matchable
from ..params import MatchParams

OUT = "kind string, source_1_id string, source_2_id string, amount_1 double, amount_2 double, date_diff long"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # one store for the state of a join in each partition, not four
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # a restart goes on from the last batch; older versions of the state go
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


@contextmanager
def disk_state(spark: SparkSession):
    """State on the executors' disks with its changes in the checkpoint, for the queries started inside."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _dealt(df: DataFrame, side: int, p: MatchParams, bin_days: int, widths: float) -> DataFrame:
    """One row for each cell: its key, the row, and its time."""
    rows = matchable(df, p)
    names = F.array_compact(F.array(F.when(F.col("vendor").isNotNull(), F.concat(F.lit("v="), F.col("vendor"))), F.when(F.col("vendor_id").isNotNull(), F.concat(F.lit("k="), F.col("vendor_id")))))
    keyed = rows.where("match_amount <> 0").withColumn("cell_name", F.explode(names))
    if side == 1:
        reach = p.max_days + 1
        keyed = keyed.withColumn("cell_day", F.explode(time_bins("date", reach, reach, bin_days))).withColumn("cell_size", F.explode(amount_bins("match_amount", p.amount_pct, widths)))
    else:
        keyed = keyed.withColumns({"cell_day": time_bin("date", bin_days), "cell_size": amount_bin("match_amount", p.amount_pct, widths)})
    return keyed.select(
        F.col("cell_name").alias(f"cell_name_{side}"), F.col("cell_day").cast("long").alias(f"cell_day_{side}"),
        F.concat_ws("/", F.signum("match_amount"), F.col("cell_size")).alias(f"cell_size_{side}"),
        F.col("txn_id").alias(f"id_{side}"), F.col("match_amount").alias(f"amount_{side}"), F.col("vendor").alias(f"name_{side}"), F.col("date").alias(f"date_{side}"),
    )


def stream_reconcile(cards: DataFrame, bank: DataFrame, p: MatchParams = MatchParams(), watermark: str = "1 day", bin_days: int = 64, widths: float = 40) -> DataFrame:
    """Events of two gold streams: ``pair`` with both ids, amounts and whole days apart, and ``alone`` with one id for each cell in which a
    row found no partner. Vendor name or id, day rounding and the sign option are those of the batch. ``cells`` that are narrower
    (``bin_days``, ``widths``) spread a hot vendor further, at more copies of each card row.

    Rows without amount, date or vendor can never match and come out alone at once, as do amounts of 0. A row that comes later than the
    watermark allows is dropped, as in every stream. ``final_matches`` makes the batch's tables of the events.
    """
    card, bank_row = (_dealt(df.withWatermark("date", watermark), side, p, bin_days, widths) for side, df in ((1, cards), (2, bank)))
    one_cell = (F.col("cell_name_1") == F.col("cell_name_2")) & (F.col("cell_day_1") == F.col("cell_day_2")) & (F.col("cell_size_1") == F.col("cell_size_2"))
    # tells the state how long a row may wait; the exact days follow
    reach = F.expr(f"interval {p.max_days + 1} days")
    in_time = (F.col("date_1") >= F.col("date_2") - reach) & (F.col("date_1") <= F.col("date_2") + reach)
    days = days_apart("date_1", "date_2")
    near = (days <= p.max_days) & (relative_gap("amount_1", "amount_2") <= p.amount_pct)
    # pairs with one name come out of the cell of the name, not of the id as well
    twice = F.startswith("cell_name_1", F.lit("k=")) & F.coalesce((F.col("name_1") == F.col("name_2")) & (F.col("name_1") != ""), F.lit(False))
    met = card.join(bank_row, one_cell & in_time & near & ~twice, "full_outer")
    events = met.select(
        F.when(F.col("cell_name_1").isNotNull() & F.col("cell_name_2").isNotNull(), "pair").otherwise("alone").alias("kind"),
        F.col("id_1").alias("source_1_id"),
        F.col("id_2").alias("source_2_id"),
        "amount_1",
        "amount_2",
        days.alias("date_diff"),
    )

    def unmatchable(df: DataFrame, side: int) -> DataFrame:
        amount = F.when(~F.isnan("amount"), F.col("amount"))
        never = amount.isNull() | (amount == 0) | F.col("date").isNull() | (F.col("vendor").isNull() & F.coalesce(F.col("vendor_id") == "", F.lit(True)))
        ids = [F.when(F.lit(side == s), F.col("txn_id")) for s in (1, 2)]
        return df.where(never).select(F.lit("alone"), *ids, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("long"))

    return events.union(unmatchable(cards, 1)).union(unmatchable(bank, 2))


def final_matches(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs, and the ids of both sides that are in none (side 1 or 2, txn_id), of the written events."""
    pairs = events.where("kind = 'pair'").drop("kind")
    sides = []
    for side, c in ((1, "source_1_id"), (2, "source_2_id")):
        alone = events.where(F.col("kind") == "alone").where(F.col(c).isNotNull()).select(F.col(c).alias("txn_id")).distinct()
        sides.append(alone.join(pairs.select(F.col(c).alias("txn_id")).distinct(), "txn_id", "left_anti").select(F.lit(side).alias("side"), "txn_id"))
    return pairs, sides[0].union(sides[1])


def run_reconcile(cards: DataFrame, bank: DataFrame, out: str, p: MatchParams = MatchParams(), watermark: str = "1 day") -> StreamingQuery:
    """Reconcile all that is there, then stop; a restart goes on where the checkpoint in ``out`` ends."""
    with disk_state(cards.sparkSession):
        return (
            stream_reconcile(cards, bank, p, watermark)
            .writeStream.format("parquet")
            .option("path", f"{out}/events")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
