"""SimHash near-duplicates by the generalised pigeonhole principle (operator 11).

1. A row's fingerprint holds 64 bits, each the majority of that bit over the hashes of its word shingles.
2. The bits are dealt into parts, correlated bits into one part, and every part gets a threshold of its own: thresholds t with a sum of
   (t + 1) over the parts one above the allowed distance. Two fingerprints within that distance are within the threshold in at least
   one part. Partition and thresholds are chosen by dynamic programming on the candidates and probes that a sample lets expect;
   they decide about the cost, never about the result.
3. Each fingerprint goes to the cells of its value in each part and of the values around it within the threshold. The members of a
   cell are compared in full; only the ties that join them are reported. A cell too large for a task is dealt out again, by
   parts of the bits not used so far, which loses nothing: what is within the distance on all bits is so on the rest.
4. Ties make components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, slices, written

SEED = 42
#: Shingles of one text whose bits are counted at a time.
COUNTED = 100_000
#: Fingerprints, those of the least hashes, that the plan of parts and thresholds is estimated from, and those compared in pairs for it.
SAMPLE, PAIRED = 20_000, 2_000
#: Cost of one probe and of one comparison, for the plan only.
PROBE_COST, COMPARE_COST = 1.0, 0.01
#: Members a cell may have before it is dealt out again, and how often that is done.
CELL, LEVELS = 4096, 4
#: Cells of up to so many members are compared together, by their distance in the sorted rows.
SMALL = 64


def fingerprint(text: str | None, size: int = 4) -> bytes:
    """64 bits, most significant first; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), COUNTED):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + COUNTED], last[at : at + COUNTED], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(first)).tobytes()


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = b"".join([fingerprint(t, size) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@dataclass
class Plan:
    """Masks of the parts and their thresholds (-1: the part is not probed)."""

    masks: list[int]
    thresholds: list[int]


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def grouped_bits(sample: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` groups of nearly equal width; a group grows by the bit that is most correlated with those it has."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
    spread = bits - bits.mean(0) if len(bits) else np.zeros((1, 64))
    norm = np.sqrt((spread**2).sum(0))
    related = np.abs(spread.T @ spread) / np.maximum(np.outer(norm, norm), 1e-9)
    free, masks = list(range(64)), []
    for part in range(parts):
        width = (64 - (64 - len(free))) // (parts - part)
        group = [max(free, key=lambda b: (related[b, free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (related[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        masks.append(sum(1 << b for b in group))
    return masks


def _costs(masks: list[int], sample: np.ndarray, rows: int, distance: int) -> list[list[float]]:
    """Expected cost of each part at each threshold from 0 on."""
    few = sample[:PAIRED]
    out = []
    for mask in masks:
        width = mask.bit_count()
        apart = np.bitwise_count((few[:, None] ^ few[None, :]) & np.uint64(mask))
        near = np.bincount(apart.ravel(), minlength=65)
        near[0] -= len(few)
        pairs = max(len(few) * (len(few) - 1), 1)
        costs = []
        for t in range(distance + 1):
            share = max(near[: t + 1].sum() / pairs, _ball(width, t) / 2.0**width)
            costs.append(PROBE_COST * rows * _ball(width, t) + COMPARE_COST * share * rows * rows / 2)
        out.append(costs)
    return out


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with a sum of (t + 1) of ``distance`` + 1; -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                option = (cost + (own[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in grown or option < grown[used + t + 1]:
                    grown[used + t + 1] = option
        best = grown
    return best[distance + 1]


def plan_parts(sample: np.ndarray, rows: int, distance: int) -> Plan:
    """The cheapest partition with its thresholds, over all numbers of parts up to ``distance`` + 1."""
    options = []
    for parts in range(2, distance + 2):
        masks = grouped_bits(sample, parts)
        cost, thresholds = allocate(_costs(masks, sample, rows, distance), distance)
        options.append((cost, masks, thresholds))
    _, masks, thresholds = min(options)
    return Plan(masks, thresholds)


def _flips(mask: int, radius: int) -> np.ndarray:
    """Every change of at most ``radius`` bits of a mask, none first."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([sum(c) for k in range(radius + 1) for c in combinations(bits, k)], np.uint64)


def _cell_of(parent: np.ndarray, part: int, value: np.ndarray) -> np.ndarray:
    """A number for a cell. Two cells with one number would be compared as one, at some cost and with the same result."""
    x = parent ^ (value + np.uint64(0x9E3779B97F4A7C15 * (part + 1) % (1 << 64)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_CELLS = "cell long, rest long, own boolean, fp long"


def first_cells(prints: DataFrame, plan: Plan) -> DataFrame:
    """(cell, rest, own, fp): the cells of each fingerprint; rest: bits outside of the part, own: the cell's value is its own."""
    work = [(p, np.uint64(m), _flips(m, t)) for p, (m, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for part, mask, flips in work:
                step = max(1, 200_000 // max(len(fp), 1))
                for at in range(0, len(flips), step):
                    some = flips[at : at + step]
                    value = ((fp & mask)[:, None] ^ some[None, :]).ravel()
                    cell = _cell_of(np.zeros(len(value), np.uint64), part, value)
                    own = np.tile(some == 0, len(fp))
                    rest = np.full(len(value), np.uint64(~mask), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(own), pa.array(np.repeat(fp, len(some)).view(np.int64))], ["cell", "rest", "own", "fp"])

    return prints.mapInArrow(run, _CELLS)


def next_cells(large: DataFrame, distance: int) -> DataFrame:
    """Cells of the members of too large cells, by equal values in distance + 1 groups of the bits that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rest, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("cell", "rest", "fp"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for left in np.unique(rest).tolist():
                at = np.flatnonzero(rest == left)
                bits = [b for b in range(64) if left >> b & 1]
                for part in range(distance + 1):
                    mask = sum(1 << b for b in bits[part :: distance + 1])
                    named = _cell_of(cell[at], part, fp[at] & np.uint64(mask))
                    remain = np.full(len(at), left & ~mask, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(remain.view(np.int64)), pa.array(own[at]), pa.array(fp[at].view(np.int64))], ["cell", "rest", "own", "fp"])

    return large.mapInArrow(run, _CELLS)


def ties_within(fp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(u, v) that tie the members of one cell reachable from its own ones: a search that compares each one found with those not found yet."""
    out, rest = [], np.arange(len(fp))
    done = np.zeros(len(fp), bool)
    for seed in np.flatnonzero(own).tolist():
        if done[seed]:
            continue
        done[seed] = True
        rest = rest[~done[rest]]
        waiting = [seed]
        while waiting and len(rest):
            x = waiting.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                done[found] = True
                waiting += found.tolist()
                out.append((np.full(len(found), fp[seed]), fp[found]))
        if not len(rest):
            break
    return out


def cell_ties(cell: np.ndarray, own: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties inside all cells of sorted rows."""
    starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] ^ np.uint64(1)) != 0)
    lengths = np.diff(np.append(starts, len(cell)))
    run = np.repeat(np.arange(len(starts)), lengths)
    look = lengths > SMALL
    small = (lengths > 1) & ~look
    at = np.flatnonzero(small[run])
    for j in range(1, int(lengths[small].max(initial=1))):
        a, b = at[:-j], at[j:]
        same = (run[a] == run[b]) & (own[a] | own[b])
        a, b = a[same], b[same]
        look[run[a[np.bitwise_count(fp[a] ^ fp[b]) <= distance]]] = True
    out = []
    for r in np.flatnonzero(look).tolist():
        part = slice(starts[r], starts[r] + lengths[r])
        out += ties_within(fp[part], own[part], distance)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def compare_cells(cells: DataFrame, distance: int, most: int | None) -> DataFrame:
    """Ties (u, v) of all cells, and the members (cell, rest, own, fp) of those above ``most``, in one pass over the sorted cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ties(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            u, v = cell_ties(rows[0], rows[2], rows[3], distance)
            if len(u):
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), none, none, pa.nulls(len(u), pa.bool_()), none], names)

        def passed(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            none = pa.nulls(len(rows[0]), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(rows[0].view(np.int64)), pa.array(rows[1].view(np.int64)), pa.array(rows[2]), pa.array(rows[3].view(np.int64))], names)

        names = ["u", "v", "cell", "rest", "own", "fp"]
        held: tuple[np.ndarray, ...] | None = None  # the open cell
        large = None  # the cell that is passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "rest", "own", "fp"))
            now = (now[0].view(np.uint64), now[1].view(np.uint64), now[2], now[3].view(np.uint64))
            if large is not None:
                same = int(np.searchsorted(now[0] != large, True))
                if same:
                    yield passed(tuple(x[:same] for x in now))
                    now = tuple(x[same:] for x in now)
                if not len(now[0]):
                    continue
                large = None
            if held is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
            last = int(np.flatnonzero(np.diff(now[0], prepend=now[0][:1] ^ np.uint64(1)) != 0)[-1])
            yield from whole(tuple(x[:last] for x in now), ties, passed)
            held = tuple(x[last:] for x in now)
            if most is not None and len(held[0]) > most:
                yield passed(held)
                large, held = held[0][0], None
        if held is not None:
            yield from ties(held)

    def whole(rows, ties, passed) -> Iterator[pa.RecordBatch]:
        if not len(rows[0]):
            return
        if most is not None:
            starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] ^ np.uint64(1)) != 0)
            lengths = np.diff(np.append(starts, len(rows[0])))
            big = np.repeat(lengths > most, lengths)
            if big.any():
                yield passed(tuple(x[big] for x in rows))
                rows = tuple(x[~big] for x in rows)
        if len(rows[0]):
            yield from ties(rows)

    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "u long, v long, cell long, rest long, own boolean, fp long")


def near_ties(prints: DataFrame, plan: Plan, distance: int) -> DataFrame:
    """(u, v) that tie all fingerprints of ``prints`` (fp, each once) within ``distance`` bits into their components."""
    cells, ties = first_cells(prints, plan), None
    for level in range(LEVELS):
        found = written(compare_cells(cells, distance, CELL if level + 1 < LEVELS else None), f"simhash-{level}")
        own = found.where("u IS NOT NULL").select("u", "v")
        ties = own if ties is None else ties.union(own)
        large = found.where("u IS NULL").select("cell", "rest", "own", "fp")
        if large.isEmpty():
            break
        cells = next_cells(large, distance)
    return ties


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4) -> DataFrame:
    """doc_id, fp (signed number) and component_id, the least doc_id reachable by fingerprints within ``distance`` bits, of every row.

    Words stand between ASCII white space, A to Z in lower case; shingles of ``size`` words count as often as they occur; fewer words
    are one shingle. Null and empty texts have fingerprint zero and are linked like any other. Rows with one fingerprint,
    repeated rows among them, are one node; a row without doc_id takes part, and gets a null component only if all rows of its component
    lack one. Only (doc_id, text) are read.
    """
    prints = written(fingerprints(docs, size), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    rows = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    ties = near_ties(nodes.select("fp"), plan_parts(sample, rows, distance), distance)
    roots = components(ties, "simhash-components").withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
