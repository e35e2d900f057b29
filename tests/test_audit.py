import pytest
from helpers import at, gold, rows
from pyspark.sql import functions as F

from ledgerlens.operators import corrupt, escalate, evaluate, feedback, monitor, trail
from ledgerlens.plans.audit import run_audit
from ledgerlens.plans import testbed

CARD = (
    "expense_id string, expense_date date, cardholder_id string, cardholder_name string, card_program string, "
    "card_last4 string, category string, merchant string, amount double, client_count_at_time int"
)


def test_full_severity(spark):
    df = spark.createDataFrame(
        [("a", False, 85, False, False), ("b", False, 65, True, False), ("c", True, 10, True, True)],
        "txn_id string, matched boolean, anomaly_score int, email_approval boolean, receipt_found boolean",
    )
    got = rows(escalate.severity_full(df), "txn_id", "severity_score", "severity_level")
    assert got == [("a", 100, "CRITICAL"), ("b", 50, "WARNING"), ("c", 0, "INFO")]


def test_escalation(spark):
    df = spark.createDataFrame(
        [("CRITICAL", 2000.0, "A"), ("INFO", 25.0, "A"), ("WARNING", 10.0, "W"), ("WARNING", 99.0, "W"), ("INFO", None, "A")],
        "severity_level string, amount double, vendor string",
    )
    white = spark.createDataFrame([("W",)], "vendor string")
    live = rows(escalate.escalation_rules(df, white), "vendor", "amount", "severity_level", "cfo_notice")
    assert live == sorted(
        [
            ("A", 2000.0, "CRITICAL", True),
            ("A", 25.0, "AUTO_APPROVED", False),
            ("W", 10.0, "AUTO_APPROVED", False),
            ("W", 99.0, "INFO", False),
            ("A", None, "INFO", False),
        ],
        key=repr,
    )
    tool = rows(escalate.escalation_rules(df, white, "tool"), "vendor", "amount", "severity_level")
    assert ("W", 10.0, "INFO") in tool


def test_audit_run(spark):
    cards = gold(
        spark,
        [
            ("ok", 100.0, "A", None, 1),
            ("free", 100.0, "B", None, 1),  # only unmatched and small: no flag
            ("nan", float("nan"), "A", None, 1),
            ("dup", 60.0, "A", None, 1),
            ("dup", 60.0, "A", None, 2),
            ("big", 6000.0, "A", None, 1),
            ("tiny", 20.0, None, None, 1),
        ],
    )
    bank = gold(spark, [("b1", 100.0, "A", None, 1), ("b2", 60.0, "A", None, 1), ("b3", 6000.0, "A", None, 1)], "bank")
    r = run_audit(cards, bank, "run", "2025-02-01")
    got = rows(r.flags, "transaction_id", "severity_level", "factors")
    assert got == [
        ("big", "CRITICAL", ["no_reconciliation_match", "high_amount"]),
        ("dup", "INFO", ["duplicate_transaction"]),
        ("nan", "CRITICAL", ["no_reconciliation_match", "incomplete_data"]),
        ("tiny", "CRITICAL", ["no_reconciliation_match", "incomplete_data"]),
    ]
    flag = r.flags.filter("transaction_id = 'big'").first()
    assert len(flag.flag_id) == 36
    assert flag.explanation == (
        "Flagged because: No matching bank transaction found for $6000.00 to A; "
        "Transaction amount $6000.00 exceeds high-value threshold."
    )
    s = r.summary.first()
    assert (s.transactions_processed, s.flags_created, s.critical, s.info) == (7, 4, 3, 1)
    chain = trail.decision_chains(r.flags.filter("transaction_id = 'big'")).first().decision_chain
    assert [c.agent for c in chain] == ["Reconciliation", "Escalation", "Escalation"]
    with pytest.raises(Exception, match="quality gate failed"):
        run_audit(cards, bank, "run", "2025-02-01", completeness_threshold=0.99, halt_on_gate=True)


def test_confusion_matrix(spark):
    flags = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "2"), ("d", "9")], "dataset_name string, txn_id string")
    truth = spark.createDataFrame([("d", "1"), ("d", "2"), ("d", "3")], "dataset_name string, txn_id string")
    totals = spark.createDataFrame([("d", 12, 10), ("clean", 5, 5)], "dataset_name string, total_rows long, total_ids long")
    m = {r.dataset_name: r for r in evaluate.confusion_matrix(flags, truth, totals).collect()}
    assert (m["d"].tp, m["d"].fp, m["d"].fn, m["d"].tn) == (2, 1, 1, 8)
    assert (m["clean"].precision, m["clean"].metrics_defined, m["clean"].accuracy) == (None, False, 1.0)
    assert evaluate.confusion_matrix(flags, truth, totals, distinct_ids=True).filter("dataset_name = 'd'").first().tn == 6
    s = evaluate.benchmark_summary(evaluate.confusion_matrix(flags, truth, totals)).first()
    assert (s.scored_datasets, s.skipped_datasets, s.all_passed) == (1, 1, False)


def test_corruption_sizes_and_truth(spark, small_limits):
    data = [(f"EXP_{i:07d}", at(i % 90).date(), "h", "Holder", "p", "1", f"cat{i % 3}", "M", 100.0, 1) for i in range(200)]
    cards = spark.createDataFrame(data, CARD)
    missing = corrupt.corrupt_missing(cards)
    assert missing.truth.count() == 30 and missing.data.count() == 200
    nulled = missing.data.filter("merchant is null or amount is null or expense_date is null")
    assert rows(nulled, "expense_id") == rows(missing.truth, "txn_id")
    dup = corrupt.corrupt_duplicates(cards)
    assert dup.truth.count() == 20
    assert 240 <= dup.data.count() <= 260
    bank = gold(spark, [(f"B{i}", 1.0, "A", None, 1) for i in range(20)], "bank")
    c, b, truth = corrupt.corrupt_orphans(cards, bank)
    assert (c.count(), b.count(), truth.count()) == (250, 10, 50)
    extra = c.filter("amount >= 5000")
    assert extra.count() == 50 and rows(extra, "expense_id")[0] == ("EXP_0000200",)


def test_feedback_loop(spark):
    data = [(f"f{i}", f"t{i}", "v1" if i < 10 else "v2", "V", i < 9, "false_positive" if i < 9 else None) for i in range(12)]
    flags = spark.createDataFrame(
        data, "flag_id string, txn string, vendor_id string, vendor string, reviewed boolean, human_decision string"
    ).selectExpr("*", "timestamp'2025-01-05' as created_at", "array('amount_outlier') as factors")
    rates = feedback.fp_rate_by_vendor(flags, "2025-01-07")
    assert rows(rates, "vendor_id", "fp_rate") == [("v1", 0.9)]
    none = spark.createDataFrame([], "vendor_id string")
    listed = feedback.vendors_to_whitelist(rates, none)
    sigma = feedback.sigma_adjustments(feedback.fp_rate_by_rule(flags, "2025-01-07"), 2.5)
    assert sigma.first().new_sigma == 3.0
    rules = feedback.current_rules(feedback.rule_changes(listed, sigma, "2025-01-07"))
    assert rows(rules, "rule", "value") == [("amount_outlier.sigma", "3.0"), ("whitelist:v1", "true")]
    assert feedback.fp_rate_by_vendor(flags, "2025-02-07").count() == 0


def test_alerts_and_cost(spark):
    metrics = spark.createDataFrame(
        [("agent_success_rate", "a", 0.89), ("agent_success_rate", "b", 0.90), ("false_positive_rate", "x", 0.21)],
        "metric string, label string, value double",
    )
    assert rows(monitor.alert_hits(metrics), "alert", "label") == [("AgentFailureSpike", "a"), ("FalsePositiveRateHigh", "x")]
    log = spark.createDataFrame([("m", "s", 1_000_000), ("other", "s", 2_000_000)], "llm_model string, agent_name string, llm_tokens_used long")
    prices = spark.createDataFrame([("m", 0.8)], "llm_model string, dollars_per_million double")
    assert rows(trail.cost_report(log, prices, 0.15), "llm_model", "cost_dollars") == [("m", 0.8), ("other", 0.3)]


def test_injected_corruption_is_found(spark):
    """Audit of a corrupted table against its own truth."""
    from ledgerlens.operators.filters import incomplete_rows
    from ledgerlens.sources.gold import to_gold

    root = "/root/testdata/sf0.001"
    job = corrupt.corrupt_missing(testbed.card_expenses(spark, root))
    found = incomplete_rows(to_gold(job.data, "credit_card")).selectExpr("'m' as dataset_name", "txn_id")
    truth = job.truth.selectExpr("'m' as dataset_name", "txn_id")
    totals = job.data.selectExpr("1 as one").groupBy().count().selectExpr("'m' as dataset_name", "count as total_rows")
    assert evaluate.confusion_matrix(found, truth, totals).first().f1_score == 1.0


def test_reachable_equals_a_search(spark):
    import random

    from ledgerlens.operators import trail

    rng = random.Random(4)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)] + [("n1", "n1"), ("n2", "n3"), ("n3", "n2")]
    df = spark.createDataFrame(edges, "from_node string, to_node string")
    starts = ["n1", "n2", "n7", "absent"]
    frame = spark.createDataFrame([(s,) for s in [*starts, "n1", None]], "node string")
    for backward in (False, True):
        want = []
        for s in starts:
            depth, front = {s: 0}, [s]
            while front:
                front = [y for x in front for a, b in edges for y in [(a if backward else b)] if (b if backward else a) == x and y not in depth and not depth.update({y: depth[x] + 1})]
            want += [(s, n, d) for n, d in depth.items() if d]
        assert rows(trail.reachable(df, frame, backward), "start", "node", "depth") == sorted(want, key=repr)


def test_full_audit_with_learned_rules(spark):
    from ledgerlens.params import AnomalyParams
    from ledgerlens.plans.audit import full_audit, learned

    cards = gold(
        spark,
        [("ok", 100.0, "A", "1", 1), ("seen", 100.0, "B", "2", 1), ("lone", 900.0, "C", "3", 1), ("mail", 900.0, "D", "4", 1), ("twice", 100.0, "A", "1", 1), ("twice", 100.0, "A", "1", 1), ("void", None, "A", "1", 2), ("tiny", 5.0, "E", "5", 1)],
    )
    bank = gold(spark, [(f"b{i}", 100.0, v, k, 1) for i, (v, k) in enumerate([("A", "1"), ("B", "2"), ("A", "1"), ("A", "1")])], "bank")
    emails = spark.createDataFrame([("e1", "D order", "", "x", "t", at(1)), ("e2", "Re", "approved", "boss", "t", at(2))], "email_id string, subject string, body string, sender string, thread_id string, email_date timestamp")
    events = spark.createDataFrame([], "event_id string, title string, description string, event_date timestamp")
    receipts = spark.createDataFrame([("r", "f.jpg", "D LTD", 900.0, at(1).date())], "receipt_id string, file_path string, ocr_vendor string, ocr_amount double, ocr_date date")
    args = cards, bank, emails, events, receipts, "run", "2025-02-01"
    run = full_audit(*args)
    got = {r.transaction_id: (r.severity_level, tuple(r.factors)) for r in run.flags.collect()}
    assert got == {
        "lone": ("WARNING", ("no_reconciliation_match", "no_email_approval", "no_receipt")),
        "mail": ("INFO", ("no_reconciliation_match",)),
        "twice": ("INFO", ("no_email_approval", "no_receipt")),
        "void": ("WARNING", ("no_reconciliation_match", "no_email_approval", "no_receipt")),
        "tiny": ("WARNING", ("no_reconciliation_match", "no_email_approval", "no_receipt")),
    }
    steps = [(r.log_sequence_number, r.agent_name, r.output_summary) for r in run.trail.orderBy("log_sequence_number").collect()]
    assert steps[1] == (2, "Reconciliation", "4 pairs") and steps[4] == (5, "Escalation", "5 flags") and len(steps) == 6
    state, summary = run.state.first(), run.summary.first()
    assert (state.workflow_status, summary.flags_created, summary.transactions_processed) == ("completed", 5, 8)
    # what reviewers taught: vendor C is trusted, amounts may spread wider
    rules = spark.createDataFrame([("whitelist:3", "true"), ("whitelist:4", "false"), ("amount_outlier.sigma", "3.5")], "rule string, value string")
    vendors, params = learned(rules, cards, AnomalyParams())
    assert [r.vendor for r in vendors.collect()] == ["C"] and params.amount_sigma == 3.5 and params.profile_sigma == 3.0
    taught = {r.transaction_id: r.severity_level for r in full_audit(*args, rules=rules, include_forest=True).flags.collect()}
    assert taught["lone"] == "INFO" and taught["void"] in ("WARNING", "CRITICAL")


@pytest.mark.parametrize("keys", [[], ["category"]])
def test_rows_are_chosen_by_hash_and_only_those_at_the_limit_are_ranked(spark, monkeypatch, keys):
    """As a ranking of all rows would choose, copies and missing ids included."""
    import hashlib

    ids = [("a" if i % 3 else "b", f"E{i % 17000}") for i in range(20_000)] + [("b", None), ("c", "E1")]
    df = spark.createDataFrame(ids, "category string, expense_id string")
    ranked = []
    plain = corrupt.number_rows
    monkeypatch.setattr(corrupt, "number_rows", lambda part, *a: ranked.append(part.count()) or plain(part, *a))
    got = corrupt._chosen(42, "some", df, keys, F.lit(700)).where("picked")
    want = []
    for k in ("a", "b", "c") if keys else (None,):
        part = [e for c, e in ids if k is None or c == k]
        part.sort(key=lambda e: (hashlib.md5("|".join(["42", "some", *([] if e is None else [e])]).encode()).hexdigest(), e or ""))
        want += part[:700]
    assert sorted(map(str, (r.expense_id for r in got.collect()))) == sorted(map(str, want))
    assert ranked[0] < 500
