"""Flags against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(
    flags: DataFrame, truth_ids: DataFrame, totals: DataFrame, distinct_ids: bool = False
) -> DataFrame:
    """Per data set TP, FP, FN, TN on distinct ids, and the derived measures (NULL where undefined).

    ``flags`` and ``truth_ids``: dataset_name, txn_id. ``totals``: dataset_name, total_rows (and, for
    ``distinct_ids``, total_ids). With row totals, TN also counts extra copies of an id.
    """
    keys = ["dataset_name", "txn_id"]
    flagged = flags.select(*keys).distinct().withColumn("_f", F.lit(True))
    true = truth_ids.select(*keys).distinct().withColumn("_t", F.lit(True))
    sets = flagged.join(true, keys, "full").groupBy("dataset_name").agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("tp"),
        F.count_if(F.col("_f").isNotNull() & F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_f").isNull() & F.col("_t").isNotNull()).alias("fn"),
    )
    zero = F.lit(0).cast("long")
    size = F.col("total_ids" if distinct_ids else "total_rows")
    m = totals.join(sets, "dataset_name", "left").select(
        "dataset_name",
        size.alias("total"),
        F.coalesce("tp", zero).alias("tp"),
        F.coalesce("fp", zero).alias("fp"),
        F.coalesce("fn", zero).alias("fn"),
    )
    m = m.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    m = m.withColumns(
        {
            "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return m.select(
        "dataset_name",
        "tp",
        "fp",
        "tn",
        "fn",
        "precision",
        "recall",
        F.try_divide(2 * p * r, p + r).alias("f1_score"),
        F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("total")), F.lit(0.0)).alias("accuracy"),
        (F.col("tp") + F.col("fn") > 0).alias("metrics_defined"),
    )


def dataset_verdicts(matrix: DataFrame, pass_f1: float = 0.80, floor: float = 0.80) -> DataFrame:
    """Per data set: passed (NULL if undefined) and advice on low recall or precision."""
    d = F.col("metrics_defined")
    return matrix.select(
        "dataset_name",
        F.when(d, F.coalesce(F.col("f1_score") >= pass_f1, F.lit(False))).alias("passed"),
        F.coalesce(d & (F.col("recall") < floor), F.lit(False)).alias("improve_detection"),
        F.coalesce(d & (F.col("precision") < floor), F.lit(False)).alias("reduce_false_positives"),
    )


def benchmark_summary(matrix: DataFrame, pass_f1: float = 0.80) -> DataFrame:
    """One row: macro averages over data sets with defined measures, best and worst by F1, all passed."""
    d = F.col("metrics_defined")
    f1 = F.col("f1_score")
    ranked = F.when(d & f1.isNotNull(), F.struct("f1_score", "dataset_name"))
    return matrix.agg(
        F.count_if(d).alias("scored_datasets"),
        F.count_if(~d).alias("skipped_datasets"),
        F.avg(F.when(d, F.col("precision"))).alias("avg_precision"),
        F.avg(F.when(d, F.col("recall"))).alias("avg_recall"),
        F.avg(F.when(d, f1)).alias("avg_f1"),
        F.max(ranked)["dataset_name"].alias("best_dataset"),
        F.min(ranked)["dataset_name"].alias("worst_dataset"),
        F.coalesce(F.bool_and(F.when(d, F.coalesce(f1 >= pass_f1, F.lit(False)))), F.lit(True)).alias("all_passed"),
    )


def severity_breakdown(flags: DataFrame) -> DataFrame:
    return flags.groupBy("severity_level").agg(F.count("*").alias("flags"))


def expected_range_check(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Is the number of flags per data set within the expected range? ``truth`` has the range columns."""
    counts = flags.groupBy("dataset_name").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return truth.join(counts, "dataset_name", "left").select(
        "dataset_name",
        n.alias("flags_created"),
        "flags_created_min",
        "flags_created_max",
        n.between(F.col("flags_created_min"), F.col("flags_created_max")).alias("in_range"),
    )
