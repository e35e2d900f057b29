"""Benchmark decontamination by latent semantic retrieval (operator 7).

Words are hashed to a fixed number of terms; document frequencies come from all rows. A randomised SVD of TF-IDF passages gives a
small latent space: every task multiplies its passages with the same random matrix and back, the products are
summed, and the driver only sees that sum, terms times dimensions. Each benchmark item is compared by cosine with the windows of its own length in every
document. Candidates are confirmed by the longest common subsequence of words with the item, and by that with its last part, the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices
from ledgerlens.llm.kernels import Words

TERMS = 1 << 15
DIMENSIONS = 64
#: Words in a block; windows begin at blocks and hold whole blocks.
BLOCK = 8
#: Terms with so few words in a slice are added up many at a time, in groups of GROUP.
FEW, GROUP = 8, 2048
#: Terms in a piece of a matrix that tasks exchange.
PART = 512
#: Items that are searched at a time: what a task holds of the benchmark.
ITEMS = 5_000
#: Longer items are searched by pieces of so many words.
PIECE = 64


@dataclass
class LatentSpace:
    """Inverse document frequency of each term and its coordinates."""

    idf: np.ndarray
    axes: np.ndarray

    def __post_init__(self):
        self.weighted = (self.axes * self.idf[:, None]).astype(np.float32)


def _terms(words: Words) -> np.ndarray:
    return (words.hashes & np.uint64(TERMS - 1)).astype(np.int64)


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and first block of each row (with the end)."""
    count = np.diff(words.first)
    per_row = -(-count // BLOCK)
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(per_row, out=first[1:])
    return np.repeat(words.first[:-1], per_row) + (np.arange(first[-1]) - np.repeat(first[:-1], per_row)) * BLOCK, first


def term_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each term, over all rows, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), at_marks=True)
            key = np.sort(np.repeat(np.arange(batch.num_rows), np.diff(words.first)) * TERMS + _terms(words))
            total += np.bincount(key[np.diff(key, prepend=-1) > 0] % TERMS, minlength=TERMS)
            rows += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([rows, *total[some].tolist()], pa.int64())], ["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(TERMS + 1, np.int64)
    table[sums.column("term").to_numpy() + 1] = sums.column("n").to_numpy()
    return table[1:], int(table[0])


def _add_products(total: np.ndarray, z: np.ndarray, block: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
    """Add to each term's row of ``total`` the weighted rows of ``z`` of its words' blocks."""
    # words in the order of their terms
    order = np.argsort(term.astype(np.uint16), kind="stable")
    term, block, weight = term[order], block[order], weight[order]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    count = np.diff(np.append(first, len(term)))
    # terms of few words: all their first words, then all their second ones and so on
    few = np.flatnonzero(count <= FEW)
    few = few[np.argsort(-count[few], kind="stable")]
    for a in range(0, len(few), GROUP):
        at, words = first[few[a : a + GROUP]], count[few[a : a + GROUP]]
        others = np.zeros((len(at), z.shape[1]), np.float32)
        for k in range(1, words[0]):
            word = at[: np.count_nonzero(words > k)] + k
            others[: len(word)] += np.take(z, block[word], axis=0, mode="clip") * weight[word, None]
        total[term[at]] += np.take(z, block[at], axis=0, mode="clip") * weight[at, None] + others
    # the others: one dimension after the other, whose numbers stay in the cache
    many = np.flatnonzero(count > FEW)
    if len(many):
        held = np.repeat(count > FEW, count)
        block, weight = block[held], weight[held]
        begin = np.cumsum(count[many]) - count[many]
        sums = np.empty((z.shape[1], len(many)), np.float32)
        for d, column in enumerate(np.ascontiguousarray(z.T)):
            np.add.reduceat(np.take(column, block, mode="clip") * weight, begin, out=sums[d])
        total[term[first[many]]] += sums.T


def _products(docs: DataFrame, idf: np.ndarray, seed: int) -> DataFrame:
    """(first, sums): for each task the product of its passages, there and back, with the random matrix, in pieces of PART terms."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block shorter than BLOCK words is filled up with one more term, which weighs nothing
        weighted = np.zeros((TERMS + 1, DIMENSIONS), np.float32)
        weighted[:-1] = np.random.default_rng(seed).standard_normal((TERMS, DIMENSIONS)).astype(np.float32) * idf[:, None]
        total = np.zeros((TERMS, DIMENSIONS), np.float32)
        for batch in slices(batches, "text", 1_000_000):
            words = Words(batch.column("text"), at_marks=True)
            starts, _ = _blocks(words)
            if not len(starts):
                continue
            t = _terms(words)
            length = np.diff(np.append(starts, len(t)))
            z = np.zeros((len(starts), DIMENSIONS), np.float32)
            for k in [*range(1, BLOCK), 0]:
                z += np.take(weighted, np.where(k < length, t[np.minimum(starts + k, len(t) - 1)], TERMS), axis=0, mode="clip")
            z /= np.maximum(np.add.reduceat(idf[t] ** 2, starts), 1e-9)[:, None]
            _add_products(total, z, np.repeat(np.arange(len(starts)), length), t, idf[t])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(0, TERMS, PART), pa.int32()), pa.array([total[i : i + PART].tobytes() for i in range(0, TERMS, PART)], pa.binary())], ["first", "sums"])

    # each task sends one matrix, so there are no more tasks than two for each core, however many files the documents are in
    tasks = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    return tasks.select(F.col("text").cast("string").alias("text")).mapInArrow(multiply, "first int, sums binary")


def fit_space(docs: DataFrame, seed: int = 7) -> LatentSpace:
    """Frequencies over all rows, then the randomised SVD over the passages of all rows."""
    frequency, rows = term_frequencies(docs)
    idf = np.log((1 + rows) / (1 + frequency)).astype(np.float32)
    mix = np.random.default_rng(seed).standard_normal((TERMS, DIMENSIONS)).astype(np.float32)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in group.column("sums").to_pylist())
        return pa.table({"first": group.column("first")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # sixteen are added at a time, so that no task gets them all
    partial = _products(docs, idf, seed).withColumn("deal", F.shiftright(F.spark_partition_id(), 4))
    sums = partial.groupBy("first", "deal").applyInArrow(add, "first int, sums binary").groupBy("first").applyInArrow(add, "first int, sums binary").toArrow()
    product = np.zeros((TERMS, DIMENSIONS))
    for first, blob in zip(sums.column("first").to_pylist(), sums.column("sums").to_pylist(), strict=True):
        product[first : first + PART] = np.frombuffer(blob, np.float32).reshape(-1, DIMENSIONS)
    if not product.any():
        return LatentSpace(idf, mix)
    # singular vectors of the passages' term matrix from its one product with the random matrix
    shift = 1e-6 * np.linalg.norm(product)
    shifted = product + shift * mix
    inner = mix.T @ shifted
    root = np.linalg.cholesky((inner + inner.T) / 2 + shift * np.eye(DIMENSIONS))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(root, shifted.T).T, full_matrices=False)
    return LatentSpace(idf, (vectors / np.maximum(values, values.max() * 1e-6)).astype(np.float32))


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit of one long number."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    free = full
    for w in region.tolist():
        hit = places.get(w)
        if hit:
            both = free & hit
            free = ((free + both) | (free - both)) & full
    return len(item) - free.bit_count()


class _Rare:
    """What a region must hold of an item before its cosine is worth computing.

    A find has ``least`` of an item's words in the region, so at most the other words are missing; of the item's rarest words, as
    many as may be missing and ``needed`` more, the region holds ``needed`` at least. No find is lost.
    """

    def __init__(self, first: np.ndarray, token_of: np.ndarray, tokens: int, often: np.ndarray, least: float):
        keys: list[np.ndarray] = []
        self.needed = np.zeros(len(first) - 1, np.int64)
        for i in range(len(first) - 1):
            own = token_of[first[i] : first[i + 1]]
            if not len(own):
                continue
            self.needed[i] = len(own) // 8 + 1
            rare = own[np.argsort(often[own], kind="stable")][: int((1 - least) * len(own) + 1e-9) + self.needed[i]]
            keys.append(rare * len(self.needed) + i)
        found, self.weight = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.item = found % len(self.needed)
        self.first = np.searchsorted(found // len(self.needed), np.arange(tokens + 2))

    def regions(self, place: np.ndarray, block: np.ndarray, blocks: int, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first block) of stretches of span[item] blocks that hold enough and begin with one of the words. ``place``: token of each word."""
        count = self.first[place + 1] - self.first[place]
        at = np.flatnonzero(count)
        count = count[at]
        ends = np.cumsum(count)
        if not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        entry = np.arange(ends[-1]) + np.repeat(self.first[place[at]] - (ends - count), count)
        key = self.item[entry] * blocks + np.repeat(block[at], count)
        order = np.argsort(key, kind="stable")
        key, total = key[order], np.concatenate([[0], np.cumsum(self.weight[entry][order])])
        begin = np.flatnonzero(np.diff(key, prepend=-1) != 0)
        item = key[begin] // blocks
        stop = np.searchsorted(key, np.minimum(key[begin] + span[item], (item + 1) * blocks))
        enough = total[stop] - total[begin] >= self.needed[item]
        return item[enough], key[begin][enough] % blocks


class _Tokens:
    """The benchmark's words: their number by hash, from a table of the hashes' upper bits, and how many words of an item a region holds."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, of = np.unique(hashes, return_inverse=True)
        self.of = of.reshape(-1)
        bits = min(max(len(self.hashes).bit_length() + 2, 8), 20)
        self.shift = np.uint64(64 - bits)
        upper = (self.hashes >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(upper, np.arange(1 << bits))
        self.most = int(np.bincount(upper).max(initial=0))
        self.padded = np.append(self.hashes, np.uint64(2**64 - 1))
        self.seen = np.zeros(len(self.hashes) + 1, bool)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; of one that is not here, how many there are."""
        at = np.take(self.begin, (hashes >> self.shift).astype(np.int64))
        for _ in range(self.most):
            at += np.take(self.padded, at) < hashes
        return np.where((np.take(self.padded, at) == hashes) & (at < len(self.hashes)), at, len(self.hashes))

    def held(self, text: np.ndarray, region: np.ndarray) -> int:
        """How many words of ``text`` are somewhere in ``region``, both by number."""
        self.seen[region] = True
        n = np.count_nonzero(self.seen[text])
        self.seen[region] = False
        return n


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all stretches [begin, end), one after the other, and where each stretch starts in them."""
    length = end - begin
    last = np.cumsum(length)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(begin - (last - length), length), last - length


def find_leaks(docs: DataFrame, benchmark: DataFrame, space: LatentSpace, cosine: float = 0.3, least: float = 0.6, answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) for every document that holds a benchmark item or a paraphrase of it.

    A candidate is an item with a window of about its own length whose cosine is at least ``cosine``. It counts if the longest common subsequence with the
    window and the same length around it holds ``least`` of the item's words and ``answer`` of its last third. The best place
    in each document is reported. Null and empty texts and items without words find nothing; repeated rows are reported
    each. The benchmark goes to the tasks in blocks of ITEMS items, one pass over the documents for each.
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id").toLocalIterator()
    out, held = None, []

    def search(items: list) -> DataFrame:
        column = pa.array([r.text for r in items], pa.string())
        numbers = [r.item_id for r in items]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Words(column, at_marks=True)
            q_terms = _terms(q)
            owners, lengths, vectors = [], [], []
            for i in range(len(numbers)):
                for a in range(q.first[i], q.first[i + 1], PIECE):
                    b = min(a + PIECE, q.first[i + 1])
                    v = space.weighted[q_terms[a:b]].sum(0)
                    if b - a >= PIECE // 2 or a == q.first[i]:
                        owners.append(i)
                        lengths.append(-(-(b - a) // BLOCK))
                        vectors.append(v / max(float(np.linalg.norm(v)), 1e-9))
            owners, lengths = np.array(owners, np.int64), np.array(lengths, np.int64)
            vectors = np.array(vectors, np.float32).reshape(-1, DIMENSIONS)
            tokens = _Tokens(q.hashes)
            sizes = np.diff(q.first)
            # words around a window that count as well, in blocks; the longest region of an item
            wide = np.where(sizes <= PIECE, 1, -(-sizes // BLOCK)) + 1
            span = np.zeros(len(sizes), np.int64)
            np.maximum.at(span, owners, lengths + 2 * wide[owners])
            piece_first = np.searchsorted(owners, np.arange(len(sizes) + 1))
            longest = np.zeros(len(sizes), np.int64)
            np.maximum.at(longest, owners, lengths)
            texts = [tokens.of[a:b] for a, b in zip(q.first[:-1], q.first[1:], strict=True)]
            rare = _Rare(q.first, tokens.of, len(tokens.hashes), -space.idf[(tokens.hashes & np.uint64(TERMS - 1)).astype(np.int64)], least)
            for batch in slices(batches, "text", 1_000_000):
                words = Words(batch.column("text"), at_marks=True)
                starts, first = _blocks(words)
                if not len(starts) or not len(owners):
                    continue
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                best: dict[tuple[int, int], tuple] = {}
                place = tokens.numbers(words.hashes)
                block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
                item, head = rare.regions(place, block, len(starts), span)
                # only stretches that hold enough of the item with all the words that a window near them may count
                around = np.where(sizes <= PIECE, BLOCK, sizes)[item]
                begin = np.maximum(starts[np.maximum(head - wide[item] - longest[item], 0)] - around, 0)
                end = starts[np.minimum(head + wide[item], len(starts) - 1)] + longest[item] * BLOCK + around
                enough = [tokens.held(texts[i], place[a:b]) >= least * len(texts[i]) for i, a, b in zip(item.tolist(), begin.tolist(), end.tolist(), strict=True)]
                enough = np.array(enough, bool)
                item, head = item[enough], head[enough]
                # every window whose region may reach such a stretch, for every piece of the item
                pieces, at = _runs(piece_first[item], piece_first[item + 1])
                item, head = (np.repeat(x, np.diff(np.append(at, len(pieces)))) for x in (item, head))
                windows, at = _runs(np.maximum(head - wide[item] - lengths[pieces], 0), np.minimum(head + wide[item] + 1, len(starts)))
                pairs = np.unique(np.repeat(pieces, np.diff(np.append(at, len(windows)))) * len(starts) + windows)
                terms = _terms(words)
                for part in range(0, len(pairs), 4096):
                    k, w = np.divmod(pairs[part : part + 4096], len(starts))
                    i, length = owners[k], lengths[k]
                    last = np.minimum(w + length, first[row[w] + 1])
                    end = np.where(last < first[row[w] + 1], starts[np.minimum(last, len(starts) - 1)], words.first[row[w] + 1])
                    inside, at = _runs(starts[w], end)
                    window = np.add.reduceat(space.weighted[terms[inside]], at)
                    close = (window * vectors[k]).sum(1) / np.maximum(np.linalg.norm(window, axis=1), 1e-9)
                    around = np.where(sizes[i] <= PIECE, BLOCK, sizes[i])
                    begin = np.maximum(words.first[row[w]], starts[w] - around)
                    end = np.minimum(words.first[row[w] + 1], starts[w] + length * BLOCK + around)
                    for c in np.flatnonzero(close >= cosine).tolist():
                        j, region = i[c], place[begin[c] : end[c]]
                        text = texts[j]
                        if tokens.held(text, region) < least * len(text):
                            continue
                        share = common_subsequence(text, region) / len(text)
                        if share < least:
                            continue
                        tail = text[-max(1, len(text) // 3) :]
                        got = common_subsequence(tail, region) / len(tail)
                        key, found = (int(row[w[c]]), int(j)), (share, got, float(close[c]))
                        if got >= answer and found > best.get(key, (0.0,)):
                            best[key] = found
                if best:
                    ids = batch.column("doc_id").to_pylist()
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array([numbers[i] for _, i in keys], pa.int64()), *[pa.array([best[k][j] for k in keys], pa.float64()) for j in (2, 0, 1)]],
                        ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                    )

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

    for item in rows:
        held.append(item)
        if len(held) == ITEMS:
            found, held = search(held), []
            out = found if out is None else out.union(found)
    if held or out is None:
        found = search(held)
        out = found if out is None else out.union(found)
    return out
