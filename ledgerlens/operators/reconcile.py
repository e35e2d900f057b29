"""Reconciling two sources: candidate pairs, summaries, orphans, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import amount_bin, amount_bins, time_bin, time_bins
from ..functions.checkpoints import cut
from ..functions.columns import DAY_US, clean_number, days_apart, micros, relative_gap
from ..functions.skew import join_unique
from ..params import MatchParams, ReceiptParams

_BIN_DAYS = 16
#: Cells of vendors with fewer than ``DENSE_ROWS`` rows: wide, so that few rows reach a second one.
_WIDE_DAYS, _WIDE_WIDTHS = 96, 24
DENSE_ROWS = 4096


def tolerance_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    pct: float,
    days: int,
    floor_days: bool = True,
    bin_days: int = _BIN_DAYS,
    widths: float = 3,
    reach: Column | None = None,
    dense: DataFrame | None = None,
    only_left: Column | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` columns, amounts within ``pct`` of the left amount and dates within ``days``.

    ``left`` has (l_amount, l_date, ...), ``right`` has (r_amount, r_date, ...). The join key is ``on`` plus a
    date bin and a logarithmic amount bin, so a hot vendor spreads over its dates and amounts; the left
    side is repeated for the bins it can reach (about two in all with the default bins) and the exact
    predicate decides. ``floor_days``: days are whole days rounded down (a gap of -3.5 counts 4, +3.9 counts 3);
    otherwise exactly ``days`` to both sides. Narrow bins (``bin_days``, ``widths``) suit joins without another key, where cells are
    dense. ``reach``: whole days per left row, if it needs to look less far than ``days``. ``dense``: the values of ``on`` with so
    many rows that they need these cells; all others have wide ones (1.2 copies of a left row instead of two). ``only_left``: left rows
    with a partner that fits this condition as well, instead of pairs, which are not formed; a row comes once for each cell with a partner.
    """
    if dense is not None:
        if dense.isEmpty():
            bin_days, widths = _WIDE_DAYS, _WIDE_WIDTHS
        else:
            marked = dense.select(*on, F.lit(True).alias("_dense"))
            left, right = (side.join(marked, list(on), "left") for side in (left, right))

    def cells(make, narrow: float, wide: float) -> Column:
        return F.when(F.col("_dense"), make(narrow)).otherwise(make(wide)) if "_dense" in left.columns else make(narrow)

    around = F.lit(days + 1) if reach is None else F.least(reach, F.lit(days)) + 1
    probe = (
        left.withColumn("_day", F.explode(cells(lambda w: time_bins("l_date", around, around, w), bin_days, _WIDE_DAYS)))
        .withColumn("_mag", F.explode(cells(lambda w: amount_bins("l_amount", pct, w), widths, _WIDE_WIDTHS)))
        .withColumn("_sign", F.signum("l_amount"))
    )
    build = right.withColumns(
        {
            "_day": cells(lambda w: time_bin("r_date", w), bin_days, _WIDE_DAYS),
            "_mag": cells(lambda w: amount_bin("r_amount", pct, w), widths, _WIDE_WIDTHS),
            "_sign": F.signum("r_amount"),
        }
    )
    # whole days rounded down, then absolute, is at most d: -d days <= difference < d + 1 days
    ahead = micros("l_date") - micros("r_date")
    limit = days * DAY_US
    near = (ahead >= -limit) & (ahead < limit + DAY_US if floor_days else ahead <= limit)
    close = relative_gap("l_amount", "r_amount") <= pct
    probe, build = probe.drop("_dense"), build.drop("_dense")
    keys = [*on, "_day", "_mag", "_sign"]
    if only_left is not None:
        build = build.select(*[F.col(c).alias(f"_r{c}") for c in keys], "r_amount", "r_date")
        same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_r{c}") for c in keys])
        return probe.join(build, same & near & close & only_left, "left_semi").drop("_day", "_mag", "_sign")
    return probe.join(build, keys).filter(near & close).drop("_day", "_mag", "_sign")


def matchable(df: DataFrame, p: MatchParams) -> DataFrame:
    """Rows that can match at all, with empty vendor ids as NULL and the amount the tolerance is applied to."""
    amount = clean_number("amount")
    if p.sign_insensitive:
        amount = F.abs(amount)
    out = df.withColumns({"match_amount": amount, "vendor_id": F.nullif(F.col("vendor_id"), F.lit(""))})
    return out.filter(
        F.col("match_amount").isNotNull()
        & F.col("date").isNotNull()
        & (F.col("vendor").isNotNull() | F.col("vendor_id").isNotNull())
    )


def vendor_or_id_pairs(left: DataFrame, right: DataFrame, p: MatchParams) -> DataFrame:
    """Tolerance pairs with the same vendor id, then those with the same vendor name but another id.

    Inputs carry l_/r_ prefixed vendor, vendor_id, amount and date. Two equi joins stay shuffled hash or
    sort-merge joins; a single OR condition would be a nested loop. Only names that occur with several ids, or
    without an id, have pairs of the second kind; the rows of all other names are shuffled once.
    """
    known = cut(
        left.select(F.col("l_vendor").alias("v"), F.col("l_vendor_id").alias("k"))
        .unionByName(right.select(F.col("r_vendor").alias("v"), F.col("r_vendor_id").alias("k")))
        .groupBy("v", "k")
        .agg(F.count("*").alias("n"))
    )

    def pairs(l_rows: DataFrame, r_rows: DataFrame, c: str, dense: DataFrame) -> DataFrame:
        l_rows, r_rows = (rows.withColumn("_key", F.col(f"{side}_{c}")).filter("_key is not null") for side, rows in (("l", l_rows), ("r", r_rows)))
        return tolerance_join(l_rows, r_rows, ["_key"], p.amount_pct, p.max_days, dense=dense)

    def dense(c: str) -> DataFrame:
        sums = known.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_key")).agg(F.sum("n").alias("n"))
        return cut(sums.filter(F.col("n") >= DENSE_ROWS).select("_key"))

    by_id = pairs(left, right, "vendor_id", dense("k")).drop("_key")
    several = cut(known.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.count("k").alias("ids")).filter("n > 1 or ids = 0").select("v"))
    if several.isEmpty():
        return by_id
    l_rows, r_rows = (rows.join(several, F.col(f"{side}_vendor") == F.col("v"), "left_semi") for side, rows in (("l", left), ("r", right)))
    by_name = pairs(l_rows, r_rows, "vendor", dense("v"))
    by_name = by_name.filter(~F.coalesce(F.col("l_vendor_id") == F.col("r_vendor_id"), F.lit(False)))
    return by_id.unionByName(by_name.drop("_key"))


def _side(df: DataFrame, prefix: str, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{name}") for name, c in columns.items()])


def match_candidates(s1: DataFrame, s2: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """All pairs that the tolerances allow."""
    columns = {
        "txn_id": "txn_id",
        "amount": "match_amount",
        "vendor": "vendor",
        "vendor_id": "vendor_id",
        "date": "date",
    }
    pairs = vendor_or_id_pairs(_side(matchable(s1, p), "l", columns), _side(matchable(s2, p), "r", columns), p)
    return pairs.select(
        F.col("l_txn_id").alias("source_1_id"),
        F.col("r_txn_id").alias("source_2_id"),
        F.col("l_amount").alias("amount_1"),
        F.col("r_amount").alias("amount_2"),
        days_apart("l_date", "r_date").alias("date_diff"),
    )


def unmatched(side: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Rows of one side whose id is in no pair (``id_col`` is source_1_id or source_2_id)."""
    taken = pairs.select(F.col(id_col).alias("txn_id")).distinct()
    return join_unique(side, taken, ["txn_id"], "left_anti")


def match_summary(s1: DataFrame, s2: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals and match rate; 0.0 if a side is empty."""
    rows = [s1.agg(F.count("*")).scalar(), s2.agg(F.count("*")).scalar()]
    free = [
        unmatched(s1, pairs, "source_1_id").agg(F.count("*")).scalar(),
        unmatched(s2, pairs, "source_2_id").agg(F.count("*")).scalar(),
    ]
    total = pairs.agg(F.count("*").alias("total_matched"))
    rate = F.round(F.coalesce(F.try_divide(F.col("total_matched"), rows[0]), F.lit(0.0)), 3)
    return total.select(
        "total_matched",
        free[0].alias("total_unmatched_1"),
        free[1].alias("total_unmatched_2"),
        F.when((rows[0] > 0) & (rows[1] > 0), rate).otherwise(F.lit(0.0)).alias("match_rate"),
    )


def low_confidence_matches(pairs: DataFrame, max_confidence: float = 0.90) -> DataFrame:
    return pairs.filter(F.col("confidence") < max_confidence)


def orphan_transactions(txns: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows whose (amount, vendor, date) occurs in one source only. Rows without a vendor never count;
    a missing amount or date is a value like any other."""
    amount = clean_number("amount")
    # numbers, the most telling one first: they are compared faster than texts; -0.0 is not 0.0, as in the texts of the SQL
    keyed = txns.filter(F.col("source").isin(*sources) & F.col("vendor").isNotNull()).withColumns(
        {
            "_amount": F.coalesce(amount, F.lit(float("nan"))),
            "_date": F.coalesce(micros("date"), F.lit(-(2**63))),
            "_minus": F.coalesce((amount == 0) & (amount.cast("string") == "-0.0"), F.lit(False)),
        }
    )
    keys = ["_amount", "_date", "vendor", "_minus"]
    place = F.array_position(F.array(*[F.lit(x) for x in sources]), F.col("source"))
    per_key = keyed.select(*keys, place.alias("_place")).groupBy(*keys).agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    shared = per_key.filter("_lo < _hi").select(*keys)
    return join_unique(keyed, shared, keys, "left_anti").select(*txns.columns)


def missing_receipts(
    cards: DataFrame,
    receipts: DataFrame,
    as_of: str,
    grace_days: int = 7,
    exclude_vendors: Sequence[str] = (),
    p: ReceiptParams = ReceiptParams(),
) -> DataFrame:
    """Card rows older than the grace period without a receipt of the same vendor, near amount and near date."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {grace_days} days")
    due = cards.filter(F.col("date") < cutoff)
    if exclude_vendors:
        due = due.filter(~F.coalesce(F.col("vendor").isin(*exclude_vendors), F.lit(False)))
    # copies of a payment share one lookup
    keys = ["vendor", "amount", "date"]
    wanted = due.select(*keys).distinct().select(
        "vendor", F.col("amount").alias("l_amount"), F.col("date").alias("l_date")
    )
    offered = receipts.select("vendor", F.col("amount").alias("r_amount"), F.col("date").alias("r_date")).distinct()
    covered = (
        tolerance_join(wanted, offered, ["vendor"], p.amount_pct, p.max_days)
        .select("vendor", F.col("l_amount").alias("amount"), F.col("l_date").alias("date"))
        .distinct()
    )
    return join_unique(due, covered, keys, "left_anti").select(*cards.columns)


def receipt_coverage(cards: DataFrame, bank: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows and date range per source, and receipts per card row."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("source"),
            F.count("*").alias("rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )

    parts = reduce(
        DataFrame.unionByName, [one(cards, "credit_card"), one(bank, "bank"), one(receipts, "receipts")]
    )
    expenses = cards.agg(F.count("*")).scalar()
    rate = F.when(F.col("source") == "receipts", F.round(F.try_divide(F.col("rows"), expenses), 3))
    return parts.withColumn("coverage", rate)
