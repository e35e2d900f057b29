"""Substring deduplication by content-defined chunks (operator 3).

A gear hash runs over the bytes of each text; a chunk ends where some of its bits are zero, which depends on the sixteen bytes
before alone, so that an insertion moves no border further on. Chunks are compared by a 128-bit digest; neighbouring chunks that
an earlier document has too form a repeated span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import slices, written
from ledgerlens.llm.kernels import BYTE_HASH, column_bytes

#: A border where these bits of the gear hash are zero: one in 32 places. Bit 15 is the last that 16 bytes fill.
BORDER_BITS = np.uint32(0b11111 << 11)
WINDOW = 16
#: No border so soon after another possible one, and one at the latest after so many bytes.
LEAST, MOST = 16, 1024
_GEAR = (BYTE_HASH >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all rows, in byte offsets into ``data``, rising; every row's end is one."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    hit = np.flatnonzero((h & BORDER_BITS) == 0) + 1
    # a row's first bytes would see the row before
    start = offsets[np.searchsorted(offsets, hit, "left") - 1]
    hit = hit[hit - start >= WINDOW]
    hit = hit[np.diff(hit, prepend=-LEAST) >= LEAST]
    ends = np.unique(np.concatenate([hit, offsets[1:][np.diff(offsets) > 0]]))
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    extra = (ends - begins - 1) // MOST
    if extra.any():
        long = np.flatnonzero(extra)
        step = np.arange(extra[long].sum()) - np.repeat(np.cumsum(extra[long]) - extra[long], extra[long]) + 1
        ends = np.unique(np.concatenate([ends, np.repeat(begins[long], extra[long]) + step * MOST]))
    return ends


CHUNKS = "doc_id long, row long, n int, start long, end long, words int, hi long, lo long"


def chunk_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """The chunks of every row: doc_id, a number of the row, number, byte range, words that begin in it, and digest (two longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = column_bytes(batch.column("text"))
            ends = borders(data, offsets)
            if not len(ends):
                continue
            begins = np.concatenate([[0], ends[:-1]])
            row = np.searchsorted(offsets, ends, "left") - 1
            blank = _SPACE[data]
            opens = ~blank
            opens[1:] &= blank[:-1]
            some = offsets[:-1][np.diff(offsets) > 0]
            opens[some] = ~blank[some]
            count = np.zeros(len(data) + 1, np.int64)
            np.cumsum(opens, out=count[1:])
            blob = data.tobytes()
            digests = np.frombuffer(b"".join([hashlib.blake2b(blob[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            first = np.searchsorted(row, np.arange(len(offsets) - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array((np.arange(len(row)) - first[row]).astype(np.int32)), pa.array(begins - offsets[row]), pa.array(ends - offsets[row]),
                    pa.array((count[ends] - count[begins]).astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                ],
                ["doc_id", "row", "n", "start", "end", "words", "hi", "lo"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, CHUNKS)


def repeated_spans(docs: DataFrame, least_words: int = 25, text: str = "text") -> DataFrame:
    """Spans of whole chunks that an earlier document (by doc_id) holds too: doc_id, row, start_byte, end_byte, n_words, n_chunks, first_doc_id.

    Neighbouring chunks form one span; spans with fewer than ``least_words`` words are left out, as short chunks repeat by
    chance. A passage loses up to a chunk at each end, so one of over 50 words keeps well over 25. Repeats inside one document do not
    count. ``first_doc_id`` is the earliest document with the span's first chunk. Null and empty texts have no chunk. Chunks meet in a grouped
    minimum that is combined before the shuffle, then in an equi join with one row per digest.
    """
    chunks = written(chunk_table(docs, text), "chunks")
    first = chunks.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    again = chunks.join(first, ["hi", "lo"]).where("doc_id > first_doc_id")
    run = F.col("n") - F.row_number().over(Window.partitionBy("row").orderBy("n"))
    spans = again.withColumn("run", run).groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.min_by("first_doc_id", "n").alias("first_doc_id")
    )
    return spans.where(F.col("n_words") >= least_words).drop("run")


def without_spans(texts: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``texts`` (doc_id, text, ...) with the byte ranges in ``spans`` taken out; doc_id is taken to be unique."""
    lists = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("cut_out"))
    joined = texts.join(lists, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, cuts in zip(batch.column(text).to_pylist(), batch.column("cut_out").to_pylist(), strict=True):
                if t is not None and cuts:
                    blob, parts, at = t.encode(), [], 0
                    for c in cuts:
                        parts.append(blob[at : c["start_byte"]])
                        at = c["end_byte"]
                    t = b"".join([*parts, blob[at:]]).decode("utf-8", "ignore")
                out.append(t)
            columns = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in batch.schema.names if n != "cut_out"]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "cut_out"])

    return joined.mapInArrow(run, T.StructType([f for f in joined.schema.fields if f.name != "cut_out"]))
