import pytest
from helpers import at, gold, rows

from ledgerlens.operators import filters, quality

NAN = float("nan")


def test_completeness_counts_null_and_nan_and_absent_columns(spark):
    data = [("1", "A", 1.0, at(0), "bank"), ("2", None, 2.0, at(1), "bank"), ("3", "B", 3.0, at(2), None)]
    data += [("4", "C", 4.0, at(3), "bank"), ("5", "D", 5.0, at(4), "bank")]
    df = spark.createDataFrame(data, "txn_id string, vendor string, amount double, date timestamp, source string")
    r = quality.completeness(df).first()
    assert (r.total_records, r.missing_vendor, r.missing_source, r.completeness_score) == (5, 1, 1, 0.9)
    assert quality.completeness(df.drop("source")).first().missing_source == 5
    empty = quality.completeness(df.limit(0)).first()
    assert (empty.total_records, empty.completeness_score) == (0, 0.0)
    nan = gold(spark, [("1", NAN, "A", None, 0)])
    assert quality.completeness(nan).first().missing_amount == 1
    assert filters.incomplete_rows(nan).count() == 1


def test_duplicates(spark, small_limits):
    ids = ["001", "001", "002", "003", "003"]
    df = gold(spark, [(i, 1.0, "A", None, 0) for i in ids])
    assert quality.duplicate_rows(df, ["txn_id"]).count() == 4
    groups = rows(quality.duplicate_groups(df, ["txn_id"]), "txn_id", "count", "ids")
    assert groups == [("001", 2, ["001", "001"]), ("003", 2, ["003", "003"])]
    assert quality.duplicate_rows(df, ["absent"]).count() == 0
    nulls = gold(spark, [("1", 1.0, None, None, 0), ("2", 1.0, None, None, 0), ("3", 1.0, "A", None, 0)])
    assert rows(quality.duplicate_rows(nulls, ["vendor"]), "txn_id") == [("1",), ("2",)]
    assert quality.duplicate_groups(nulls, ["vendor"]).count() == 0


def test_duplicate_groups_limit_rows_before_the_shuffle(spark):
    df = gold(spark, [(str(i), 1.0, "A", None, 0) for i in range(50)])
    assert [sorted(r.ids) for r in quality.duplicate_groups(df, ["vendor"]).collect()] == [sorted(str(i) for i in range(50))]
    dealt = quality.duplicate_groups(df, ["vendor"], ids_per_row=10).collect()
    assert len(dealt) > 1 and sorted(i for r in dealt for i in r.ids) == sorted(str(i) for i in range(50)) and {r["count"] for r in dealt} == {50}
    out = quality.duplicate_groups(df, ["vendor"], max_ids=5)
    assert out.first().ids == ["0", "1", "10", "11", "12"]
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_schema_violations(spark):
    df = gold(spark, [("1", 1.0, "12", None, 0), ("2", 1.0, "x", None, 0)])
    got = rows(
        quality.schema_violations(df, {"amount": "float", "vendor": "int", "date": "datetime", "no": "str", "source": "odd"}),
        "field",
        "error",
        "bad_values",
    )
    assert got == [("no", "Missing field", 0), ("vendor", "Type mismatch", 1)]
    assert quality.schema_violations(df, {"amount": "float", "vendor": "str"}).count() == 0
    assert quality.schema_violations(df.limit(0), {"no": "str"}).count() == 0


def test_gate_and_halt(spark):
    scores = spark.createDataFrame([(0.95,), (0.85,), (0.92,), (None,)], "completeness_score double")
    passed = [r.gate_passed for r in quality.quality_gate(scores, 0.9).collect()]
    assert passed == [True, False, True, False]
    with pytest.raises(Exception, match="quality gate failed"):
        quality.quality_gate(scores, 0.9, halt=True).collect()


def test_freshness_without_any_config_falls_back(spark):
    domains = spark.createDataFrame([("x",)], "domain string")
    config = spark.createDataFrame([], "domain string, max_age_hours int, critical_amount_threshold double")
    r = quality.freshness_config(domains, config).first()
    assert (r.max_age_hours, r.confidence, r.config_source) == (48, 0.5, "fallback")


def test_row_rules(spark):
    df = gold(spark, [("1", -1.0, "A", None, 0), ("2", NAN, None, None, None)])
    got = {r.txn_id: r.violations for r in quality.row_rules(df, quality.TRANSACTION_RULES).collect()}
    assert got == {"1": ["amount_positive"], "2": ["amount_positive", "vendor_required", "date_required"]}


def test_suspicious_rows_with_and_without_anomalies(spark):
    df = gold(spark, [(f"{i:03d}", 1.0, "A", None, 0) for i in range(1, 7)])

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "txn_id string")

    args = (df, ids("001", "002"), ids("005"), ids().limit(0))
    assert filters.suspicious_transactions(*args, anomalous=ids("003", "004")).count() == 3
    assert filters.suspicious_transactions(*args, anomalous=ids("003", "004"), include_anomalies=True).count() == 5


def test_first_per_txn_puts_missing_dates_first(spark):
    df = gold(spark, [("1", 2.0, "A", None, 1), ("1", 1.0, "B", None, 0), ("2", 1.0, "C", None, 5)])
    assert rows(filters.first_per_txn(df), "txn_id", "vendor") == [("1", "B"), ("2", "C")]
