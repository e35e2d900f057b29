"""Exact duplicates by a stream with keyed state (operator 6). DataFrame operations only."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_path, no_blanks, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no file space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _disk_state(spark: SparkSession):
    """Keyed state on disk (RocksDB) while a stream is started; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_seen(observed: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream the written table ``observed`` through state keyed by digest, without expiry.

    The state of a digest holds the number of rows, and the length, doc_id and content locator of the row that stays.
    Returns the last state of every digest: digest, copies, best (n, neg_id, locator). Each micro-batch writes the digests that
    it changed into a folder of its own, which a repeated batch overwrites.
    """
    spark, out = observed.sparkSession, new_path(observed.sparkSession, "exact-state")
    source = observed.inputFiles()
    reader = spark.readStream.schema(observed.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source[0].rsplit("/", 1)[0])
    state = stream.groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct("n", (-F.col("doc_id")).alias("neg_id"), "locator")).alias("best"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/updates/b{batch}")

    with _disk_state(spark):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    schema = "digest string, copies long, best struct<n: int, neg_id: long, locator: string>, batch int"
    return spark.read.schema(schema).parquet(f"{out}/updates/*").groupBy("digest").agg(F.max_by("copies", "batch").alias("copies"), F.max_by("best", "batch").alias("best"))


def exact_duplicates(docs: DataFrame, digest: Column | None = None, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when they are the same after all ASCII white space is deleted; null counts as empty. Of equal texts the
    row with the most code points stays, then the one with the least doc_id. ``digest`` may replace SHA-256 of the
    normalised text as the key of the state: on every hit (a digest with several rows) the full texts are compared, so that a
    weak digest costs time but joins no different texts. Rows that repeat a doc_id and its text are the same document and share the
    verdict. Only the (doc_id, text) columns are read; other columns may have any name. An empty table gives no rows.
    """
    body, spark = no_blanks(F.col("text")), docs.sparkSession
    key = F.sha2(F.col("body"), 256) if digest is None else digest
    texts = docs.select(F.col("doc_id").cast("long"), body.alias("body"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = texts.select("doc_id", key.cast("string").alias("digest"), F.sha2("body", 256).alias("text_sha256"), "n", F.input_file_name().alias("locator"))
    observed = written(rows, "exact-rows")
    if not observed.inputFiles() or observed.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    state = written(first_seen(observed, files_per_batch), "exact-keep")
    hits = state.where("copies > 1").select("digest")
    bodies = written(texts.withColumn("digest", key.cast("string")).join(hits, "digest", "left_semi"), "exact-hits")
    # grouping by the whole text compares full bytes; copies are combined before the shuffle
    groups = written(bodies.groupBy("digest", "body").agg(F.count("*").alias("copies"), F.max(F.struct("n", (-F.col("doc_id")).alias("neg_id"))).alias("best")), "exact-groups")
    mixed = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    plain = observed.join(state.join(mixed, "digest", "left_anti"), "digest").select("doc_id", "text_sha256", (-F.col("best.neg_id")).alias("keep_id"), "copies")
    split = bodies.join(groups.join(mixed, "digest", "left_semi"), ["digest", "body"]).select("doc_id", F.sha2("body", 256).alias("text_sha256"), (-F.col("best.neg_id")).alias("keep_id"), "copies")
    return plain.union(split).select("doc_id", "keep_id", F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS n FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
