import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

ROOT = "/root/testdata/sf0.001"
SOME = ["completeness", "duplicate_groups", "match_candidates", "rolling_deviation", "approval_chains", "cost_report"]


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events", "conversations"):
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    got = entry.queries()[name](spark, ROOT)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want
