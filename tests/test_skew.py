import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlens.functions.skew import join_unique, number_rows


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_unique_equals_plain_join_with_heavy_and_null_keys(spark, small_limits, how):
    rng = random.Random(1)
    keys = ["hot"] * 40 + [None] * 9 + [f"k{rng.randrange(12)}" for _ in range(30)]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    got = join_unique(left, right, ["k"], how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert rows(got, *got.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_unique_is_cut_where_the_left_side_is_skewed(spark, how):
    """No counting beforehand; adaptive execution cuts the hot partition of the left side."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # the hot key, then NULL keys, each in most rows
        for hot in ("'hot'", "cast(null as string)"):
            left = spark.range(0, 60_000, 1, 8).selectExpr(f"case when id % 10 < 8 then {hot} else 'k' || id % 500 end as k", "id")
            right = spark.range(500).selectExpr("'k' || id as k", "id as v").union(spark.createDataFrame([("hot", 1)], "k string, v long"))
            out = join_unique(left, right, ["k"], how)
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            if hot == "'hot'" or how in ("left", "left_anti"):
                assert "skew=true" in plan, plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_number_rows_with_copies_and_heavy_groups(spark, small_limits, keys):
    rng = random.Random(2)
    data = [("a", rng.randrange(60), "x") for _ in range(200)]
    data += [("a", 7, "x")] * 50 + [("b", rng.randrange(5), "y") for _ in range(12)] + [("c", 1, "z")]
    df = spark.createDataFrame(data, "g string, o int, t string").repartition(5)
    order = ["o", "t"] if keys else ["g", "o", "t"]
    got = number_rows(df, keys, order)
    want = []
    groups = sorted({r[0] for r in data}) if keys else [None]
    for g in groups:
        part = [r for r in data if g is None or r[0] == g]
        part.sort(key=(lambda r: r[1:]) if keys else (lambda r: r))
        want += [(*r, n) for n, r in enumerate(part, 1)]
    assert rows(got, "g", "o", "t", "row") == sorted(want, key=repr)


def test_number_rows_splits_the_whole_table(spark, small_limits):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = [tuple(r) for r in number_rows(df, [], ["v"]).collect()]
    assert sorted(got) == [(i, i + 1) for i in range(1000)]


def test_number_rows_compares_no_row_with_every_limit(spark, small_limits, monkeypatch):
    """A table without keys was cut by comparing each row with all limits; null keys have numbers of their own."""
    from ledgerlens.functions import skew

    monkeypatch.setattr(skew, "split_heavy", lambda *a: pytest.fail("limits"))
    df = spark.createDataFrame([(None, 5), (None, 3), ("a", 1), ("a", 1), ("a", None)], "g string, o int")
    assert rows(number_rows(df, ["g"], ["o"]), "g", "o", "row") == sorted([(None, 3, 1), (None, 5, 2), ("a", None, 1), ("a", 1, 2), ("a", 1, 3)], key=repr)
    assert [r.row for r in number_rows(df, [], ["g", "o"]).orderBy("row").collect()] == [1, 2, 3, 4, 5]
