"""Named tables for SQL users."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Register each frame as a temp view; ``gold.transactions`` is reachable as ``gold_transactions``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name.replace(".", "_"))


def register_directory(spark: SparkSession, root: str, names: list[str]) -> None:
    """Register Parquet directories ``root/name`` (or ``root/name.parquet``) under their names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        folder = f"{root}/{name}"
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(conf).exists(path):
            folder += ".parquet"
        spark.read.parquet(folder).createOrReplaceTempView(name.replace(".", "_"))


def audit_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run the user's SQL; frames may be passed by name and used as ``{name}``."""
    return spark.sql(sql, **tables)
