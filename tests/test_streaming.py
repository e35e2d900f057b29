import random
import uuid

import pytest
from helpers import at, gold, rows
from pyspark.sql import functions as F

from ledgerlens.operators import quality, reconcile
from ledgerlens.params import MatchParams
from ledgerlens.plans.audit import run_audit
from ledgerlens.schemas import GOLD
from ledgerlens.streaming import incremental, jobs
from ledgerlens.streaming import reconcile as reconcile_stream


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drain(df, tmp_path, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = (
        df.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / name))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def made(rng, prefix, n):
    return [
        (f"{prefix}{rng.randrange(n) if rng.random() < 0.2 and prefix == 'c' else i}", rng.choice([10.0, 40.0, 100.0, 102.0, 6000.0, None]), rng.choice(["A", "B", "C", None]), rng.choice([None, "1", "2", ""]), rng.choice([None, *range(12)]))
        for i in range(n)
    ]


def flags_in(df):
    return sorted((r.transaction_id, r.severity_level, tuple(r.factors), r.explanation) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_audit_equals_one_audit_of_everything(spark, tmp_path, batches):
    """Batches in any order of dates, with a failure between the writes and the commit of the second one."""
    rng = random.Random(batches)
    cards, bank = made(rng, "c", 60), gold(spark, made(rng, "b", 50), "bank")
    for i in range(batches):
        write(gold(spark, cards[i::batches]), tmp_path / "in")
    source = spark.readStream.schema(GOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = incremental.AuditState(spark, str(tmp_path / "out"))

    def run():
        q = incremental.stream_audit(source, lambda: bank, state.root, str(tmp_path / "cp"), "2025-02-01", audit_run_id="r")
        q.awaitTermination()

    commit = incremental.AuditState.commit
    if batches > 1:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(incremental.AuditState, "commit", lambda self, v: commit(self, v) if v < 1 else 1 / 0)
            with pytest.raises(Exception, match="division by zero"):
                run()
        assert state.committed() == [0]
        first = run_audit(gold(spark, cards[0::batches]), bank, "r", "2025-02-01").flags
        assert flags_in(incremental.current_flags(state)) == flags_in(first)
    run()
    run()
    want = run_audit(gold(spark, cards), bank, "r", "2025-02-01")
    assert flags_in(incremental.current_flags(state)) == flags_in(want.flags)
    assert rows(incremental.current_pairs(state), "source_1_id", "source_2_id") == rows(want.pairs, "source_1_id", "source_2_id")


def test_bank_rows_that_come_later(spark, tmp_path):
    cards = [gold(spark, [("a", 100.0, "A", None, 1), ("x", 100.0, "X", "9", 1)]), gold(spark, [("b", 100.0, "B", None, 1)])]
    bank = [gold(spark, [("1", 100.0, "Q", None, 1)], "bank"), gold(spark, [("1", 100.0, "Q", None, 1), ("2", 100.0, "A", None, 2), ("3", 100.0, "Z", "9", 2)], "bank")]
    state = incremental.AuditState(spark, str(tmp_path))
    for v in range(2):
        incremental.audit_batch(state, cards[v], bank[v], v, "r", "2025-02-01")
    want = run_audit(cards[0].union(cards[1]), bank[1], "r", "2025-02-01")
    assert flags_in(incremental.current_flags(state)) == flags_in(want.flags)
    assert rows(incremental.current_pairs(state), "source_1_id", "source_2_id") == [("a", "2"), ("x", "3")]


def test_stream_duplicates(spark, tmp_path):
    write(gold(spark, [("1", 1.0, "A", None, 0), ("1", 1.0, "A", None, 0), ("2", 1.0, "A", None, 0)]), tmp_path / "in")
    out = drain(jobs.stream_duplicates(jobs.read_stream(spark, str(tmp_path / "in"), GOLD)), tmp_path)
    assert rows(out, "txn_id") == [("1",), ("2",)]


def test_stream_quality_drops_late_rows(spark, tmp_path):
    df = gold(spark, [("1", 1.0, "A", None, 0.0), ("2", None, "A", None, 0.01), ("3", 1.0, "A", None, 9)])
    write(df, tmp_path / "in")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), GOLD)
    out = drain(jobs.stream_quality(stream), tmp_path)
    got = rows(out, "window_start", "rows", "missing_amount", "missing_source", "completeness_score")
    assert got == [(at(0), 2, 1, 0, 0.875)]
    batch = quality.completeness(df.filter("date < '2025-01-02'")).first()
    assert batch.completeness_score == 0.875


def test_overview_equals_the_windows_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    data = [(str(i), rng.choice([None, 1.0]), rng.choice([None, "A"]), None, round(rng.random() * 3, 4)) for i in range(80)] + [("end", 1.0, "A", None, 30)]
    data.sort(key=lambda r: r[4])
    for i in range(0, len(data), 27):
        write(gold(spark, data[i : i + 27]), tmp_path / "in")
    # a row that comes after its windows are out is dropped
    write(gold(spark, [("late", 1.0, "A", None, 0.5)]), tmp_path / "in")
    stream = spark.readStream.schema(GOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(jobs.stream_quality_overview(stream), tmp_path)
    df = gold(spark, data[:-1]).groupBy(F.window("date", "24 hours", "1 hour")).agg(F.count("*").alias("rows"), F.count_if(F.expr("amount is null")).alias("missing_amount"), F.count_if(F.expr("vendor is null")).alias("missing_vendor"))
    columns = ["window_start", "rows", "missing_amount", "missing_vendor"]
    assert rows(got, *columns) == rows(df.withColumn("window_start", F.col("window.start")), *columns)


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_reconcile_equals_the_batch(spark, tmp_path, batches):
    rng = random.Random(batches)
    sides = {}
    for name, prefix in (("credit_card", "c"), ("bank", "b")):
        data = [(f"{prefix}{i}", *r[1:]) for i, r in enumerate(made(rng, prefix, 70))]
        data = [(i, a if a is None or rng.random() < 0.9 else -a, v, k, None if d is None else d + rng.choice([0, 0.5, 0.9])) for i, a, v, k, d in data]
        sides[name] = data
        data = sorted(data, key=lambda r: (r[4] is not None, r[4] or 0))
        cut = -(-len(data) // batches)
        for i in range(0, len(data), cut):
            write(gold(spark, data[i : i + cut], name), tmp_path / name)
        write(gold(spark, [(f"end-{name}", 1.0, name, None, 900)], name), tmp_path / name)
    streams = [spark.readStream.schema(GOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in sides]
    for p in (MatchParams(), MatchParams(sign_insensitive=True)):
        out = str(tmp_path / f"out{p.sign_insensitive}")
        reconcile_stream.run_reconcile(*streams, out, p, watermark="12 days").awaitTermination()
        pairs, alone = reconcile_stream.final_matches(spark.read.parquet(f"{out}/events"))
        cards, bank = (gold(spark, sides[n], n) for n in sides)
        want = reconcile.match_candidates(cards, bank, p)
        columns = ["source_1_id", "source_2_id", "amount_1", "amount_2", "date_diff"]
        assert rows(pairs, *columns) == rows(want, *columns) and pairs.count() > 20
        free = [(s, i) for s, n, c in ((1, "credit_card", "source_1_id"), (2, "bank", "source_2_id")) for i in {r[0] for r in sides[n]} - {r[0] for r in want.select(c).collect()}]
        assert sorted(r for r in rows(alone, "side", "txn_id") if not r[1].startswith("end")) == sorted(free)


def test_stream_reconcile_forgets_a_row_when_no_partner_can_come(spark, tmp_path):
    """A row without partner is reported once the watermark has passed its own days, and its state is kept by Spark's join, not by
    Python for each cell, which took more than five minutes for 600,000 rows."""
    for name, prefix in (("credit_card", "c"), ("bank", "b")):
        write(gold(spark, [(f"{prefix}1", 10.0, f"only {name}", None, 0), (f"{prefix}2", 10.0, "V", None, 0)], name), tmp_path / name)
        write(gold(spark, [(f"{prefix}3", 10.0, f"late {name}", None, 9)], name), tmp_path / name)
    streams = [spark.readStream.schema(GOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in ("credit_card", "bank")]
    events = reconcile_stream.stream_reconcile(*streams)
    assert "InPandas" not in events._jdf.queryExecution().toString()
    reconcile_stream.run_reconcile(*streams, str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(reconcile_stream.OUT).parquet(f"{tmp_path}/out/events")
    assert rows(got, "kind", "source_1_id", "source_2_id") == [("alone", "c1", None), ("alone", None, "b1"), ("pair", "c2", "b2")]
