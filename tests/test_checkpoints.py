import time

from pyspark.sql import functions as F

from ledgerlens.functions.checkpoints import cut
from ledgerlens.operators import trail


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_removed(spark):
    """They stayed until the driver's garbage was collected, so an iterative plan kept all of them on disk."""
    before = shuffle_files(spark)
    held = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k")
    out = cut(held)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_table_in_buckets_is_joined_without_a_shuffle(spark):
    known = cut(spark.range(100).selectExpr("cast(id as string) as start", "cast(id % 9 as string) as node"), by=["start", "node"])
    new = spark.range(50, 150).selectExpr("cast(id as string) as start", "cast(id % 9 as string) as node")
    left = new.join(known.hint("merge"), ["start", "node"], "left_anti")
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(int(r.start) for r in left.collect()) == list(range(100, 150))


def test_starts_are_not_written(spark, monkeypatch):
    """Cycles, copies of edges, starts and missing nodes; what is written are the edges and one table for each step."""
    written = []
    monkeypatch.setattr(trail, "cut", lambda df, by=(): written.append(cut(df, by)) or written[-1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), (None, "x"), ("x", None)], "from_node string, to_node string")
    starts = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "node string")
    assert sorted(map(tuple, trail.descendants(edges, starts).collect())) == [("a", "b", 1), ("a", "c", 2)]
    assert len(written) == 4
    assert sorted(map(tuple, trail.ancestors(edges, starts).collect())) == [("a", "b", 2), ("a", "c", 1)]
    assert trail.descendants(edges, starts.where("node = 'z'")).collect() == []
