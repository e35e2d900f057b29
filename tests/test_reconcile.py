import math
import random

import pytest
from helpers import gold, rows
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import entities, matching, receipts, reconcile
from ledgerlens.params import MatchParams


def greedy(cards, bank):
    """The serial loop: rows as (txn_id, amount, vendor, vendor_id, day)."""

    def order(r):
        return (r[4], r[1], r[2] or "", r[3] or "", r[0])

    def match(a, b):
        if None in (a[1], b[1], a[4], b[4]) or a[1] == 0:
            return False
        near = abs((a[4] - b[4]) // 1) <= 3
        same = (a[2] is not None and a[2] == b[2]) or (a[3] and a[3] == b[3])
        return abs(a[1] - b[1]) / abs(a[1]) <= 0.05 and near and same

    free = sorted((b for b in bank if b[4] is not None and b[1] is not None), key=order)
    pairs = []
    for a in sorted((c for c in cards if c[4] is not None and c[1] is not None), key=order):
        for b in free:
            if match(a, b):
                pairs.append((a[0], b[0]))
                free.remove(b)
                break
    return sorted(pairs)


def pairs_of(df):
    return rows(df, "source_1_id", "source_2_id")


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_the_serial_loop(spark, seed):
    rng = random.Random(seed)

    def some(prefix, n):
        out = []
        for i in range(n):
            vendor = rng.choice(["A", "B", "C", None])
            vid = rng.choice([None, "1", "2", ""])
            out.append((f"{prefix}{i:03d}", float(rng.choice([100, 102, 104, 107, 200, 0, -50])), vendor, vid, rng.randrange(12)))
        return out

    cards, bank = some("c", 90), some("b", 90)
    cards += [(*cards[0][:1], *cards[0][1:])] * 2  # exact copies on the card side
    got = matching.match_one_to_one(gold(spark, cards), gold(spark, bank, "bank"), segment_rows=(200_000, 6, 25)[seed])
    assert pairs_of(got) == greedy(cards, bank)


@pytest.mark.parametrize("bank_days, segment_rows", [((0, 400), 40), ((3, 403), 40), ((-2, 398), 90), ((1, 300), 7)])
def test_a_long_chain_of_daily_payments(spark, monkeypatch, bank_days, segment_rows):
    """One amount every day: what is left at a segment's start shifts everything after it."""
    cards = [(f"c{i:03d}", 10.0, "A", None, i) for i in range(400)]
    bank = [(f"b{i:03d}", 10.0, "A", None, i) for i in range(*bank_days)]
    rounds, chained = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: rounds.append(tuple(df.columns)) or chained(df))
    got = matching.match_one_to_one(gold(spark, cards), gold(spark, bank, "bank"), segment_rows=segment_rows)
    assert pairs_of(got) == greedy(cards, bank)
    # two extreme histories and what they leave: the chain closes long before it was followed segment by segment
    assert rounds.count(("group", "seg", "entry", "exit")) <= 7


def test_segments_of_a_busy_vendor(spark):
    rng = random.Random(7)
    some = lambda p, n: [(f"{p}{i:04d}", float(rng.choice([100, 101, 103, 106, 110, 115])), "A", None, rng.randrange(60)) for i in range(n)]
    cards, bank = some("c", 300), some("b", 280)
    args = gold(spark, cards), gold(spark, bank, "bank")
    assert pairs_of(matching.match_one_to_one(*args, segment_rows=30)) == pairs_of(matching.match_one_to_one(*args)) == greedy(cards, bank)


def test_a_large_group_of_copies(spark, small_limits):
    cards = [(f"c{i:03d}", 10.0, "A", None, 1) for i in range(60)]
    bank = [(f"b{i:03d}", 10.0, "A", None, 1) for i in range(45)]
    got = matching.match_one_to_one(gold(spark, cards), gold(spark, bank, "bank"), segment_rows=1)
    assert pairs_of(got) == greedy(cards, bank)


def test_names_and_ids_chain_vendors(spark):
    """Every vendor shares an id with the next one: one group, walked as one."""
    cards = [(f"c{i:02d}", 10.0 + i, f"V{i:02d}", str(i // 2), i % 3) for i in range(40)]
    bank = [(f"b{i:02d}", 10.0 + i, f"V{i + 1:02d}", str(i // 2), i % 3) for i in range(40)]
    got = matching.match_one_to_one(gold(spark, cards), gold(spark, bank, "bank"), segment_rows=10)
    assert pairs_of(got) == greedy(cards, bank)


def test_confidence_reason_and_day_rounding(spark):
    cards = gold(spark, [("a", 100.0, "A", None, 10), ("b", 100.0, "B", None, 10), ("c", 100.0, "C", None, 10)])
    bank = gold(spark, [("1", 100.0, "A", None, 10.5), ("2", 101.0, "B", None, 6.1), ("3", 100.0, "C", None, 13.5)], "bank")
    got = rows(matching.match_one_to_one(cards, bank), "source_1_id", "confidence", "match_reason")
    # 10 - 10.5 days is -0.5, rounded down -1; 10 - 6.1 is 3.9, down 3; 10 - 13.5 is -3.5, down -4: no match
    assert got == [("a", 0.85, "amount_match=True, date_diff=1"), ("b", 0.85, "amount_match=True, date_diff=3")]
    same = gold(spark, [("1", 100.0, "A", None, 10)], "bank")
    assert matching.match_one_to_one(cards, same).first().confidence == 0.95


def test_negative_amounts_and_sign(spark):
    cards = gold(spark, [("a", 100.0, "A", None, 1)])
    bank = gold(spark, [("1", -100.0, "A", None, 1)], "bank")
    assert matching.match_one_to_one(cards, bank).count() == 0
    assert matching.match_one_to_one(cards, bank, MatchParams(sign_insensitive=True)).count() == 1
    assert reconcile.match_candidates(bank, bank).count() == 1


def test_summary_with_an_empty_side_keeps_the_unmatched_rows(spark):
    cards = gold(spark, [("a", 100.0, "A", None, 1)])
    none = cards.limit(0)
    pairs = matching.match_one_to_one(cards, none)
    s = reconcile.match_summary(cards, none, pairs).first()
    assert (s.total_matched, s.total_unmatched_1, s.match_rate) == (0, 1, 0.0)
    assert reconcile.unmatched(cards, pairs, "source_1_id").count() == 1


def test_orphans_ignore_missing_vendors_but_not_missing_amounts(spark):
    a = gold(spark, [("1", 5.0, "A", None, 1), ("2", None, "B", None, 1), ("3", 5.0, None, None, 1)])
    b = gold(spark, [("4", 5.0, "A", None, 1)], "bank")
    got = reconcile.orphan_transactions(a.unionByName(b), ["credit_card", "bank"])
    assert rows(got, "txn_id") == [("2",)]


def test_name_similarity(spark):
    pairs = [("Amazon", "Amazon"), ("Amazon Marketplace", "AMAZON MKTPLACE"), ("Amazon", "Walmart"), ("Amazon", None)]
    df = spark.createDataFrame(pairs, "vendor_a string, vendor_b string")
    got = {(r.vendor_a, r.vendor_b): r.similarity for r in entities.vendor_similarity(df).collect()}
    assert [got[p] for p in pairs] == [1.0, 0.909, 0.462, 0.0]


def test_fuzzy_pairs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = ["starbucks coffee", "amazon marketplace", "google workspace", "united airlines", "hilton", "ab"]

    def spoil(name):
        chars = list(name)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                del chars[at]
            else:
                chars.insert(at, rng.choice("abc x"))
        return "".join(chars).strip() or "x"

    a = sorted({spoil(n) for n in base for _ in range(6)})
    b = sorted({spoil(n) for n in base for _ in range(6)})

    def ratio(x, y):
        return round(SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio(), 3)

    want = sorted((x, y, ratio(x, y)) for x in a for y in b if ratio(x, y) >= 0.85)
    sa = spark.createDataFrame([(x,) for x in a], "vendor string")
    sb = spark.createDataFrame([(x,) for x in b], "vendor string")
    assert rows(entities.fuzzy_vendor_pairs_sequence(sa, sb), "vendor_a", "vendor_b", "similarity") == sorted(want, key=repr)


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(y):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.85, 0.95, 1.0])
def test_segment_index_loses_no_pair(spark, threshold):
    rng = random.Random(6)
    base = ["starbucks coffee", "amazon marketplace eu", "aaaaaaaa", "abababababab", "hilton", "ab", "x"]

    def spoil(name):
        chars = list(name)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "ab", "z"])
        return "".join(chars) or "x"

    sides = [[*{spoil(n) for n in base for _ in range(12)}, " Hilton ", "", None, "HILTON", "HILTON"] for _ in range(2)]
    want = set()
    for x in sides[0]:
        for y in sides[1]:
            a, b = (x or "").strip().lower(), (y or "").strip().lower()
            if a and b and (s := round(1 - levenshtein(a, b) / max(len(a), len(b)) + 1e-12, 3)) >= threshold:
                want.add((x, y, s))
    frames = [spark.createDataFrame([(x,) for x in side], "vendor string") for side in sides]
    assert rows(entities.fuzzy_vendor_pairs(*frames, threshold), "vendor_a", "vendor_b", "similarity") == sorted(want, key=repr)


def test_entities(spark):
    kg = spark.createDataFrame(
        [("amazon", "Amazon Marketplace", ["AMZN MKTP", "Amazon.com"]), ("pct", "100% Pure_Co", ["it's"])],
        "entity_id string, canonical_name string, aliases array<string>",
    )
    names = ["AMZN MKTP", "AMZN", "Amazon Marketplace", "New Shop", "it's", "%"]
    got = entities.resolve_entities(spark.createDataFrame([(n,) for n in names], "vendor string"), kg)
    assert rows(got, "vendor_name", "canonical_entity_id", "confidence") == sorted(
        [
            ("AMZN MKTP", "amazon", 0.95),
            ("AMZN", "amazon", 0.95),
            ("Amazon Marketplace", "amazon", 0.95),
            ("New Shop", "unknown_new_shop", 0.0),
            ("it's", "pct", 0.95),
            ("%", "unknown_%", 0.0),
        ],
        key=repr,
    )


@pytest.mark.parametrize("similarity", ["sequence", "levenshtein"])
def test_receipts_equal_brute_force(spark, similarity):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    vendors = ["Star Cafe", "Star Cafes", "Hilton Hotel", "Shell"]
    txns = [(f"t{i:03d}", float(rng.randrange(95, 106)), rng.choice(vendors), None, rng.randrange(20)) for i in range(120)]
    recs = [(f"r{i:03d}", float(rng.randrange(95, 106)), rng.choice([*vendors, None]), None, rng.randrange(20)) for i in range(40)]
    recs += [("zero", 0.0, "Shell", None, 1), ("minus", -5.0, "Shell", None, 1), ("undated", 100.0, "Shell", None, None)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row2 = [i]
            for j, y in enumerate(b, 1):
                row2.append(min(row2[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = row2
        return row[-1]

    def sim(a, b):
        if a is None or b is None:
            return 0.0
        a, b = a.lower().strip(), b.lower().strip()
        return round(SequenceMatcher(None, a, b).ratio() if similarity == "sequence" else 1 - lev(a, b) / max(len(a), len(b)), 3)

    want = []
    for rid, a, v, _, d in recs:
        best = None
        for tid, ta, tv, _, td in txns:
            if d is None or a <= 0 or abs(td - d) > 7 or not a * 0.95 <= ta <= a * 1.05:
                continue
            s = (1 - abs(ta - a) / a) * 0.4 + (1 - abs(td - d) / 7) * 0.3 + sim(tv, v) * 0.3
            key = (-round(s, 9), td, tid)
            best = min(best, key) if best else key
        want.append((rid, best[2] if best else None))
    got = receipts.match_receipts(gold(spark, recs), gold(spark, txns), similarity=similarity)
    assert rows(got, "receipt_id", "matched_transaction_id") == sorted(want, key=repr)


def test_missing_receipts(spark):
    cards = gold(
        spark,
        [("1", 100.0, "A", None, 1), ("2", 100.0, "B", None, 1), ("3", 100.0, "X", None, 1), ("4", 1.0, None, None, 1), ("5", 9.0, "C", None, 30)],
    )
    recs = gold(spark, [("r", 104.0, "A", None, 8)])
    got = reconcile.missing_receipts(cards, recs, "2025-02-01", exclude_vendors=["X"])
    assert rows(got, "txn_id") == [("2",), ("4",)]


def test_matching_writes_no_rows_but_the_matches(spark, monkeypatch):
    """Rows go to their vendor group in one shuffle: what is written before are names, ids and groups; copies still match one to one."""
    written = []
    plain = matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: written.append(df.columns) or plain(df))
    cards = [(f"c{i}", 10.0 + i % 4, "V", "1", i // 4) for i in range(40)] + [(f"d{i}", 5.0, None, "2", 3) for i in range(6)]
    bank = [(f"b{i}", 10.0 + i % 4, "V", "9", i // 4) for i in range(40)] + [(f"e{i}", 5.0, "W", "2", 3) for i in range(4)]
    got = matching.match_one_to_one(gold(spark, cards), gold(spark, bank, "bank"))
    assert got.count() == 44 and got.select("source_2_id").distinct().count() == 44
    assert not any("txn_id" in columns for columns in written)


@pytest.mark.parametrize("similarity", ["levenshtein", "sequence"])
def test_receipt_candidates_are_not_sorted(spark, monkeypatch, similarity):
    """Candidates keep one number per receipt in a hash table; repeated transaction ids still give the amount of the best one."""
    plans = []
    plain = receipts.cut
    monkeypatch.setattr(receipts, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or plain(df))
    txns = [("t", 101.0, "Acme", "1", 3), ("t", 103.0, "Acme", "1", 3), ("u", 103.0, "Acme", "1", 4), ("t", 99.5, "Other", "1", 3), (None, 50.0, "B", "1", 2)]
    recs = [("r1", 100.0, "Acme", "1", 2), ("r2", 102.9, "Acme", "1", 2), ("r3", 51.0, "B", "1", 2), ("r4", 7.0, "B", "1", 2)]
    got = receipts.match_receipts(gold(spark, recs), gold(spark, txns), similarity=similarity)
    assert rows(got, "receipt_id", "matched_transaction_id", "amount_delta", "date_delta_days") == [
        ("r1", "t", 1.0, 1), ("r2", "t", 0.1, 1), ("r3", None, 1.0, 0), ("r4", None, None, None)
    ]
    rings = [plan for columns, plan in plans if columns[:1] == ["rid"] and len(columns) == 2]
    assert rings and not [plan for plan in rings if "SortAggregate" in plan]


def test_candidates_of_one_name_per_id_need_one_join(spark):
    a = gold(spark, [("c1", 100.0, "V", "7", 0), ("c2", 50.0, None, None, 1)])
    b = gold(spark, [("b1", 101.0, "V", "7", 1)], "bank")
    got = reconcile.match_candidates(a, b)
    assert rows(got, "source_1_id", "source_2_id") == [("c1", "b1")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


@pytest.mark.parametrize("dense_rows", [1, 12, 4096])
def test_candidates_in_narrow_and_wide_cells(spark, monkeypatch, dense_rows):
    monkeypatch.setattr(reconcile, "DENSE_ROWS", dense_rows)
    rng = random.Random(dense_rows)
    sides = [
        [(f"{side}{i}", round(rng.uniform(60, 140), 2), rng.choice([None, "A", "B", "C"]), rng.choice([None, "", "1", "2"]), rng.randrange(30) + rng.choice([0, 0.5])) for i in range(60)]
        for side in "cb"
    ]
    sides[1] += sides[1][:5]  # a row may come twice
    got = reconcile.match_candidates(*(gold(spark, s) for s in sides))
    want = [
        (c[0], b[0])
        for c in sides[0]
        for b in sides[1]
        if ((c[2] and c[2] == b[2]) or (c[3] and c[3] == b[3])) and abs(c[1] - b[1]) / c[1] <= 0.05 and abs((c[4] - b[4]) // 1) <= 3
    ]
    assert rows(got, "source_1_id", "source_2_id") == sorted(want) and len(want) > 20


def test_orphans_take_the_values_of_all_sources_once(spark):
    """Keys are compared as numbers: a missing amount or date is a value, and -0.0 is not 0.0."""
    a = gold(spark, [("a1", None, "V", None, 0), ("a2", float("nan"), "W", None, None), ("a3", 0.0, "V", None, 2), ("a4", 5.0, "V", None, 3)])
    b = gold(spark, [("b1", float("nan"), "V", None, 0), ("b2", 1.0, "W", None, None), ("b3", -0.0, "V", None, 2), ("b4", 5.0, "V", None, 3)], "bank")
    got = reconcile.orphan_transactions(a.unionByName(b), ["credit_card", "bank"])
    assert rows(got, "txn_id") == [("a2",), ("a3",), ("b2",), ("b3",)]
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("similarity", ["levenshtein", "sequence"])
def test_few_names_of_a_crowded_day_are_compared(spark, monkeypatch, similarity):
    """Pairs were compared name by name, in Python by way of a written table of name pairs. Now the characters in common decide first, and the
    result is the same whether the most promising candidate is looked for before or not."""
    written = []
    plain = receipts.cut
    monkeypatch.setattr(receipts, "cut", lambda df: written.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or plain(df))
    rng = random.Random(5)
    names = ["Acme", " ACME", "Acme Co", "Emca", "", "aaaaaaaa", "aaaaaa", "Z\u00fcrich 12", "Zurich 21", None, "Supplier 0012", "Supplier 1200"]
    txns = [(f"t{i}", rng.choice([99.0, 100.0, 101.5, 103.0]), rng.choice(names), "1", rng.choice([2, 2.5, 3, 4, 9])) for i in range(150)]
    recs = [(f"r{i}", rng.choice([98.0, 100.0, 102.0]), rng.choice(names), "1", rng.choice([1, 2, 3.25, 5])) for i in range(60)]
    columns = ["receipt_id", "matched_transaction_id", "confidence", "amount_delta", "date_delta_days"]
    got = []
    for crowded in (0, 1e9):
        monkeypatch.setattr(receipts, "CROWDED", crowded)
        written.clear()
        got.append(rows(receipts.match_receipts(gold(spark, recs), gold(spark, txns), similarity=similarity), *columns))
        searched = [plan for c, plan in written if c == ["rid", "best"]]
        assert searched and all("bit_count" in plan for plan in searched)
        assert not [c for c, _ in written if "sim" in c]
    assert got[0] == got[1] and len(got[0]) == 60

    def score(rec, txn):
        if abs(rec[4] - txn[4]) > 7 or not rec[1] * (1 - 0.05) <= txn[1] <= rec[1] * (1 + 0.05):
            return None
        days = abs(math.floor(txn[4] - rec[4]))
        return round((1 - abs(rec[1] - txn[1]) / rec[1]) * 0.4 + (1 - days / 7) * 0.3 + alike[rec[2], txn[2]] * 0.3, 9)

    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    ratio = text.levenshtein_ratio if similarity == "levenshtein" else text.sequence_ratio
    alike = {(r.a, r.b): r.s for r in pairs.withColumn("s", ratio(F.col("a"), F.col("b"))).collect()}
    best = {rec[0]: max((s for s in (score(rec, t) for t in txns) if s is not None), default=0.0) for rec in recs}
    assert {r[0]: r[2] for r in got[0]} == pytest.approx(best, abs=0.0006)
