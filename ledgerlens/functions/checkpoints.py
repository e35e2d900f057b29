"""Cutting lineage in iterative plans, in a place that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgerlens-")
    sc.setCheckpointDir(own)
    return own


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are removed when each is done, not when the driver happens to collect garbage, which a
    driver without tasks of its own rarely does. For plans that are run once."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Parquet keeps columns, sizes and statistics, so later joins are planned on what is really there. Each
    call writes a table of its own; they can be removed when the session is over. The shuffles that led to it are removed at once.
    ``by``: columns by which it is dealt to buckets, so that joins on all of them need not shuffle it again.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_folder(spark)}/ledgerlens/{name}"
    with shuffles_removed(spark):
        if not by:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, *by).option("path", path).saveAsTable(f"cut_{name}")
    return spark.table(f"cut_{name}")
