"""Token ids in binary blocks with Elias-Fano document boundaries (operator 1).

File format: a Parquet table of blocks, so that Spark's commit protocol makes retries and lost executors safe. A block
holds the ids of consecutive documents as one little-endian array (2 bytes per id if the vocabulary allows, else 4), the
documents' ids, and the document boundaries as an Elias-Fano sequence: the low bits packed side by side, the high bits
as unary gaps, and the place of every 64th set bit for selecting an offset without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerlens.llm.common import slices
from ledgerlens.llm.kernels import column_bytes, mixed

#: Ids per block, about; a block ends with the document that reaches it.
BLOCK_IDS = 250_000
#: Every so many documents the place of the boundary's set bit is kept.
SAMPLED = 64
#: After so many encoded pieces a Python worker starts anew (it only saves time; the pool of ids takes some 10 bytes for each).
KEPT = 3_000_000
_HEAD = "<QQB"
#: Slots of the table of short pieces, 37 bytes each.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: Documents whose boundaries a reader unpacks at a time.
READ = 1024
#: Bytes that are no white space (nor zero), and those that may open a character that is none.
_BODY = np.ones(256, bool)
_BODY[[0, *range(9, 14), *range(28, 33)]] = False
_OPENS = _BODY.copy()
_OPENS[[0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Masks of the first 0 to 8 bytes of a number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("part_start", T.LongType(), False),
        T.StructField("n_docs", T.IntegerType(), False),
        T.StructField("n_ids", T.LongType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("doc_ids", T.BinaryType(), False),
        T.StructField("known", T.BinaryType(), False),
        T.StructField("boundaries", T.BinaryType(), False),
        T.StructField("ids", T.BinaryType(), False),
    ]
)


class EliasFano:
    """A rising sequence of numbers in about 2 + log2(largest / count) bits each."""

    def __init__(self, blob: bytes):
        count, top, self.low_bits = struct.unpack_from(_HEAD, blob)
        self.count = count
        n_low, n_high, n_samples = -(-count * self.low_bits // 8), -(-(count + (top >> self.low_bits)) // 8), -(-count // SAMPLED)
        at = struct.calcsize(_HEAD)
        self.low = np.frombuffer(blob, np.uint8, n_low, at)
        self.high = np.frombuffer(blob, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(blob, "<u4", n_samples, at + n_low + n_high)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        count, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // count).bit_length() - 1) if count else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> bits) + np.arange(count)
        high = np.zeros(count + (top >> bits), np.uint8)
        high[places] = 1
        return struct.pack(_HEAD, count, top, bits) + low.tobytes() + np.packbits(high, bitorder="little").tobytes() + places[::SAMPLED].astype("<u4").tobytes()

    def span(self, begin: int, end: int) -> np.ndarray:
        """The numbers ``begin`` to ``end`` (exclusive), from the kept place before them: only their own bits are read."""
        if end <= begin:
            return np.empty(0, np.int64)
        place, skipped = int(self.samples[begin // SAMPLED]), begin % SAMPLED
        wanted, size = skipped + end - begin, end - begin
        byte, held, size = place // 8, wanted // 2 + 16, end - begin
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + held], bitorder="little")[place % 8 :])
        while len(ones) < wanted:
            held *= 2
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + held], bitorder="little")[place % 8 :])
        high = ones[skipped:wanted] + place - np.arange(begin, end)
        bit = begin * self.low_bits
        low = np.unpackbits(self.low[bit // 8 : -(-end * self.low_bits // 8)], bitorder="little")[bit % 8 :][: size * self.low_bits].reshape(size, self.low_bits)
        return (high.astype(np.int64) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1, dtype=np.int64)

    def select(self, i: int) -> int:
        """The i-th number."""
        return int(self.span(i, i + 1)[0])

    def all(self) -> np.ndarray:
        return self.span(0, self.count)


def _is_body(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that end at these bytes are surely no white space."""
    last = data[at]
    keep = _BODY[last]
    wide = np.flatnonzero(last >= 0x80)
    back = at[wide]
    keep[wide] &= ~(((data[back - 1] == 0xC2) & np.isin(last[wide], (0x85, 0xA0))) | np.isin(data[back - 2], (0xE1, 0xE2, 0xE3)))
    return keep


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all pieces in the bytes of many rows, and whether a piece opens its row.

    A row is cut at a single blank between two characters that are no white space; the blank belongs to neither piece. Where a
    character may be white space beyond ASCII there is no cut, which only makes a piece longer.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    blank = np.flatnonzero(data == 32)
    blank = blank[~edge[blank] & ~edge[blank + 1]]
    cuts = blank[_is_body(data, blank - 1) & _OPENS[data[np.minimum(blank + 1, n - 1)]]]
    some = offsets[:-1] < offsets[1:]
    starts = np.sort(np.concatenate([offsets[:-1][some], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([cuts, offsets[1:][some]]), kind="stable")
    return starts, ends, edge[starts]


class PieceEncoder:
    """The tokenizer of the library, asked once for each different piece between blanks.

    Ids of the pieces met so far lie in one pool. Pieces of up to 24 bytes are found by a table of slots that holds their bytes as three numbers,
    so that all pieces of a slice are looked up at once and compared byte for byte. A new piece takes its slot from an older one, which
    is asked again when it comes back.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        self.tokenizer.model._resize_cache(0)  # each piece comes once
        blank = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array([t.startswith("\u0120") for t in blank])  # tokens that begin with a blank
        self.keys = np.zeros((3, SLOTS), np.uint64)
        self.code, self.place, self.count = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.code[:] = 0
        self.pool, self.used, self.learned = np.zeros(1 << 20, self.dtype), 0, 0

    def _add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, names: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of new pieces; an opening piece has a leading zero byte. Plain ones have a blank in front and
        none inside, so many of them make one call: their first tokens alone open with a blank."""
        place, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        single = np.flatnonzero(~plain).tolist()
        many = np.flatnonzero(plain)
        for at in range(0, len(many), 2_000):
            some = many[at : at + 2_000]
            text = (b" " + b" ".join([names[i] for i in some.tolist()])).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                place[some] = self._add(ids) + starts
                count[some] = np.diff(np.append(starts, len(ids)))
            else:
                single += some.tolist()
        for at in range(0, len(single), 2_000):
            some = single[at : at + 2_000]
            texts = [(names[i][1:] if names[i][:1] == b"\0" else b" " + names[i]).decode() for i in some]
            for i, made in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                place[i], count[i] = self._add(np.array(made.ids, self.dtype)), len(made.ids)
        self.learned += len(names)
        return place, count

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by ``end_id``, and the offset of each row in them, with the end."""
        if self.learned > KEPT:
            self._forget()
        data, offsets = column_bytes(column)
        starts, ends, opening = piece_bounds(data, offsets)
        padded = np.concatenate([data, np.zeros(40, np.uint8)])
        eight = np.ndarray(len(data) + 32, "<u8", padded, strides=(1,))
        length = ends - starts
        keys = [eight[np.minimum(starts + at, len(data))] & _BYTES[np.clip(length - at, 0, 8)] for at in (0, 8, 16)]
        code = np.where(length <= 24, length + 32 * opening, 255).astype(np.uint8)
        slot = (mixed(keys[0] + keys[1] * np.uint64(0x9E3779B97F4A7C15) + keys[2] * np.uint64(0xD1342543DE82EF95) + code) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = (code != 255) & (self.code[slot] == code)
        for kept, own in zip(self.keys, keys, strict=True):
            hit &= kept[slot] == own
        place, count = self.place[slot], self.count[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if len(missed):
            raw = data.tobytes()
            names = [(b"\0" if o else b"") + raw[a:b] for a, b, o in zip(starts[missed].tolist(), ends[missed].tolist(), opening[missed].tolist(), strict=True)]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(n, len(number)) for n in names])
            new = missed[np.unique(which, return_index=True)[1]]
            special = np.flatnonzero((data == 32) | (data == 60))
            plain = ~opening[new] & (np.searchsorted(special, starts[new]) == np.searchsorted(special, ends[new])) & _is_body(data, ends[new] - 1)
            found, sizes = self._learn(list(number), plain)
            place[missed], count[missed] = found[which], sizes[which]
            put = missed[code[missed] != 255]
            into = slot[put]
            self.code[into], self.place[into], self.count[into] = code[put], place[put], count[put]
            for kept, own in zip(self.keys, keys, strict=True):
                kept[into] = own[put]
        # one more piece closes each row
        closes = np.searchsorted(starts, offsets[1:])
        place, count = np.insert(place, closes, -1), np.insert(count, closes, 1)
        last = np.cumsum(count)
        at = np.arange(last[-1] if len(last) else 0) + np.repeat(place - (last - count), count)
        closed = np.repeat(place < 0, count)
        ids = np.where(closed, np.array(end_id, self.dtype), self.pool[np.where(closed, 0, at)])
        return ids, np.concatenate([[0], last[closes + np.arange(len(closes))]])


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``text`` of every row, append ``end_id`` and write the ids in ascending doc_id order to ``path``.

    Null texts count as empty; rows without doc_id come first; rows with the same doc_id all stay, ordered by text. One range
    shuffle of the texts; a block is closed after ``block_ids`` ids, so a task holds one block and one slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        start, held, ids, docs_held = 0, 0, [], []

        def block() -> pa.RecordBatch:
            bounds = np.cumsum([len(i) // encoder.width for i in ids])
            known = np.array([d is not None for d in docs_held], np.uint8)
            row = [part, start, len(ids), int(bounds[-1]), encoder.width, np.array([d or 0 for d in docs_held], "<i8").tobytes(), np.packbits(known).tobytes(), EliasFano.pack(bounds), b"".join(ids)]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], BLOCKS.names)

        for batch in slices(batches, "text"):
            made, at = encoder.encode(batch.column("text"), end_id)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids.append(made[a:b].tobytes())
                docs_held.append(doc)
                held += b - a
                if held >= block_ids:
                    yield block()
                    start, held, ids, docs_held = start + held, 0, [], []
        if ids:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32 bit) of each document in the file.

    Only the totals of the written parts, one number per task of the writer, are broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, count, width, docs, known, bounds, ids = (batch.column(c)[row].as_py() for c in ("first", "n_docs", "width", "doc_ids", "known", "boundaries", "ids"))
                ends = EliasFano(bounds)
                flat = np.frombuffer(ids, "<u2" if width == 2 else "<u4")
                numbers = np.frombuffer(docs, "<i8")
                nulls = np.unpackbits(np.frombuffer(known, np.uint8), count=count) == 0
                for a in range(0, count, READ):
                    b, before = min(a + READ, count), ends.select(a - 1) if a else 0
                    at = np.concatenate([[before], ends.span(a, b)])
                    texts = [flat[s:e].astype("<u4").tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[a:b], mask=nulls[a:b]), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("first"), "n_docs", "width", "doc_ids", "known", "boundaries", "ids")
    return placed.mapInArrow(run, schema)
