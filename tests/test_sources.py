import json

import pytest
from helpers import at, gold, rows

from ledgerlens import schemas
from ledgerlens.sources import catalog, readers, sinks
from ledgerlens.sources import gold as g


def test_csv_to_gold_and_bank_numbers(spark, tmp_path):
    (tmp_path / "bank.csv").write_text(
        "bank_account_id,transaction_date,description,type,amount,running_balance\n"
        "1,2025-01-03,Later,debit,-5.0,10\n1,2025-01-02,Early,debit,-6.0,20\n1,2025-01-03,Later,debit,-5.0,10\n"
    )
    bank = g.to_gold(readers.read_bank(spark, str(tmp_path / "bank.csv")), "bank")
    assert bank.columns[:6] == schemas.GOLD_COLUMNS
    assert rows(bank, "txn_id", "vendor") == [("BANK_000001", "Early"), ("BANK_000002", "Later"), ("BANK_000003", "Later")]
    (tmp_path / "receipts.csv").write_text("receipt_id,receipt_date,vendor_name,amount\nR1,2025-01-03,Shop,NaN\n")
    receipts = g.receipts_in_range(readers.read_receipts(spark, str(tmp_path / "receipts.csv")), end="2025-01-03")
    assert rows(receipts, "txn_id", "source", "amount", "vendor_id") == [("R1", "receipts", None, None)]
    cards = spark.createDataFrame([], schemas.CARD_EXPENSES)
    assert g.transactions_for_audit(cards, "2025-01-01").columns == [*schemas.GOLD_COLUMNS, *schemas.OPTIONAL_CARD_COLUMNS]


def test_json_tables_and_ground_truth(spark, tmp_path):
    mails = [{"email_id": "e", "subject": "s", "sender": "x", "date": "2025-01-01T00:00:00", "body": "b", "attachments": []}]
    (tmp_path / "mails.json").write_text(json.dumps(mails))
    raw = readers.read_json_table(spark, str(tmp_path / "mails.json"), schemas.JSON_EMAILS)
    assert rows(readers.emails_from_json(raw), "email_id", "email_date", "thread_id") == [("e", at(0), None)]
    truth = {
        "dataset_name": "d",
        "ground_truth": {"total_rows": 5, "corrupted_rows": 1, "corrupted_row_ids": ["1"], "corruption_details": {"1": {"nulled": "x"}}},
        "expected_results": {"flags_created_min": 0, "flags_created_max": 9},
    }
    (tmp_path / "metadata.json").write_text(json.dumps(truth))
    t = readers.read_ground_truth(spark, str(tmp_path / "metadata.json"))
    assert t.first().total_rows == 5
    [(txn_id, detail)] = rows(readers.ground_truth_ids(t), "txn_id", "detail")
    assert (txn_id, json.loads(detail)) == ("1", {"nulled": "x"})


def test_sinks_check_constraints_and_archive_once(spark, tmp_path):
    flags = spark.createDataFrame(
        [("f", "t", "r", "INFO", 0.5)],
        "flag_id string, transaction_id string, audit_run_id string, severity_level string, confidence_score double",
    ).selectExpr("*", "timestamp'2025-01-05 10:00:00' as created_at")
    sinks.write_flags(flags, str(tmp_path / "flags"))
    back = spark.read.parquet(str(tmp_path / "flags"))
    assert rows(back, "flag_id", "reviewed", "audit_date") == [("f", False, at(4).date())]
    with pytest.raises(Exception, match="severity_known"):
        sinks.write_flags(flags.selectExpr("* except (severity_level)", "'ODD' as severity_level"), str(tmp_path / "bad"))
    trail = spark.createDataFrame([("r1", 1, "a"), ("r2", 1, "b")], "audit_run_id string, log_sequence_number long, agent_name string")
    sinks.write_audit_trail(trail, str(tmp_path / "trail"))
    sinks.write_audit_trail(trail, str(tmp_path / "trail"))
    log = spark.read.parquet(str(tmp_path / "trail"))
    assert log.count() == 4
    sinks.archive_audit_run(log, "r1", str(tmp_path / "archive"))
    with pytest.raises(Exception):
        sinks.archive_audit_run(log, "r1", str(tmp_path / "archive"))
    summary = spark.createDataFrame([("r", 1)], "audit_run_id string, flags_created int")
    sinks.write_audit_result(summary, flags, str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result")).count() == 2


def test_sql_on_registered_tables(spark, tmp_path):
    gold(spark, [("1", 5.0, "A", None, 0)]).write.parquet(str(tmp_path / "gold.transactions"))
    catalog.register_directory(spark, str(tmp_path), ["gold.transactions"])
    assert catalog.audit_sql(spark, "select max(amount) as m from gold_transactions").first().m == 5.0


def test_new_transactions_is_strict_and_limited(spark):
    df = gold(spark, [(str(i), 1.0, "A", None, i) for i in range(5)])
    assert rows(g.new_transactions(df, "2025-01-02", 2, "date"), "txn_id") == [("2",), ("3",)]
    assert g.new_transactions(df, "2025-01-02", None, "date").count() == 3


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    gold(spark, [("1", 5.0, "A", None, 0)]).write.parquet(str(tmp_path / "t"))
    from ledgerlens.operators.filters import source_date_slice

    df = source_date_slice(spark.read.parquet(str(tmp_path / "t")), "bank", "2025-01-01", "2025-01-02").select("amount")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), IsNotNull(date), EqualTo(source,bank)" in plan
    assert "vendor" not in plan.split("ReadSchema")[1]


def test_readers_tell_malformed_from_missing(spark, tmp_path):
    from ledgerlens.schemas import JSON_EMAILS, RECEIPTS
    from ledgerlens.sources import readers

    (tmp_path / "r.csv").write_text("receipt_id,receipt_date,vendor_name,amount\n1,2025-01-02,A,5.5\n2,02.01.2025,,x\n3,,B,\n4,2025-02-30, ,1e3\n")
    got = {r.receipt_id: r for r in readers.read_receipts(spark, str(tmp_path / "r.csv"), rejects=True).collect()}
    assert [[(x.field, x.value) for x in got[i].rejects] for i in "1234"] == [[], [("receipt_date", "02.01.2025"), ("amount", "x")], [], [("receipt_date", "2025-02-30")]]
    assert (got["1"].amount, got["2"].amount, got["3"].amount, got["4"].amount) == (5.5, None, None, 1000.0)
    plain = readers.read_receipts(spark, str(tmp_path / "r.csv"))
    assert plain.columns == RECEIPTS.fieldNames() and plain.count() == 4
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('[{"email_id": "1", "attachments": ["x", "y"], "date": "2025-01-02T00:00:00Z"},\n {"email_id": "2", "attachments": 7, "extra": 1, "date": null}, {"email_id": {"a": 1}}]')
    (folder / "b.json").write_text('{"email_id": "no array"}')
    (folder / "c.json").write_text("[{broken")
    (folder / "d.json").write_text("  ")
    (folder / "e.json").write_text("[]")
    out = readers.read_json_table(spark, str(folder), JSON_EMAILS, rejects=True).collect()
    found = sorted((r.email_id or "", tuple((x.field, x.value) for x in r.rejects)) for r in out)
    assert found == sorted([("1", ()), ("2", (("attachments", "7"),)), ('{"a":1}', ()), ("", (("$", '{"email_id": "no array"}'),)), ("", (("$", "[{broken"),))])
    assert [r.attachments for r in out if r.email_id == "1"] == [["x", "y"]]
