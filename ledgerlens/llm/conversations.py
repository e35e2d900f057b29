"""Conversation structure repair (operator 13).

A conversation should read system (or not), then user and assistant in turns. Rows may be kept, get another role, go, or be
inserted, each at a price; the cheapest edits come from dynamic programming over four states: nothing yet, after the system's row, after a user's,
after an assistant's.

Rows are dealt by ranges of (conversation, turn) and sorted, so that a conversation of any size spreads over tasks. A task streams its
sorted rows over Arrow batches. A conversation that lies inside a task and is of ordinary size is solved there. Others, those at the
ends of a task's range and giant ones, leave as segments of bounded size: texts seen in an earlier segment are found by a join, each
segment becomes a map of costs from its left to its right end, the maps of a conversation are chained, and then every segment knows
the costs that follow it. It spills two bytes a row, the best edit for each state, and once the states at the ends of
the segments are chained as well, the edits are read from these bytes. No task holds more than a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, written

#: What a segment holds at most, rows and characters (and one row more).
SEGMENT_ROWS = 50_000
SEGMENT_CHARS = 4_000_000

# Prices of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
# States: nothing yet, after system, after user, after assistant.
START, FINAL = 0, (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
#: The state after an inserted or renamed row, which is always the one that is due, and its role.
DUE = (2, 2, 3, 2)
DUE_ROLE = ("user", "user", "assistant", "user")
#: (state, initial) -> state after a kept row; others cannot be kept.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
PAIRS = frozenset(("su", "ua", "au"))
INITIALS = "sua?"
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
_FAR = 1 << 60
_EDITS = ("D", "K", "R", "ID", "IK", "IR")
_steps: dict[tuple, tuple] = {}


def code_of(fault: int, role: str) -> int:
    """A row as one small number: its fault and the initial of its role (a role without one is like any that cannot be kept)."""
    at = INITIALS.find(role[:1]) if role else 3
    return fault * 4 + (3 if at < 0 else at)


def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int, int]:
    """Costs to go before a row from those after it, less their minimum, that minimum, and the first best edits of each state.

    ``after`` has its minimum at 0. The edits of state s are the s-th four bits, a place in ``_EDITS``; among equal costs the least letter
    is taken, which makes the whole string least, as different letters lead on from the same row.
    """
    got = _steps.get((after, code))
    if got:
        return got
    fault, initial = divmod(code, 4)
    extra = LEFT_TRUNCATED if fault == TRUNCATED else 0

    def own(s: int) -> list[tuple[int, int]]:
        out = [(DELETE + after[s], 0)]
        if fault < BLANK:
            kept = KEEP.get((s, INITIALS[initial]))
            if kept is not None:
                out.append((extra + after[kept], 1))
            out.append((REROLE + extra + after[DUE[s]], 2))
        return out

    # letters rank D, I, K, R: a row's own edits and an insertion before them
    costs, edits = [], 0
    for s in range(4):
        options = [(c, "DKR"[e], e) for c, e in own(s)] + [(INSERT + c, "I" + "DKR"[e], 3 + e) for c, e in own(DUE[s])]
        best = min(options)
        costs.append(min(best[0], _FAR))
        edits |= best[2] << 4 * s
    least = min(costs)
    out = (tuple(c - least if c < _FAR // 2 else _FAR for c in costs), least, edits)
    if len(_steps) > 100_000:
        _steps.clear()
    _steps[after, code] = out
    return out


def _normal(costs: Iterable[int]) -> tuple[tuple[int, ...], int]:
    costs = list(costs)
    least = min(costs)
    return tuple(c - least if c < _FAR // 2 else _FAR for c in costs), least


def backward(codes: bytes, right: Iterable[int]) -> tuple[list[int], list[int]]:
    """Costs to go at the left end and the best edits of every row for each state, from the costs at the right end."""
    now, total = _normal(right)
    edits = [0] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        now, added, edits[i] = step(now, codes[i])
        total += added
    return [c + total if c < _FAR else _FAR for c in now], edits


def follow(edits: Iterable[int], codes: bytes, state: int) -> tuple[list[str], int]:
    """The letters of each row's edits from a start state, and the state at the end."""
    out = []
    for bits, code in zip(edits, codes, strict=True):
        letters = _EDITS[bits >> 4 * state & 15]
        out.append(letters)
        if len(letters) == 2:
            state = DUE[state]
        last = letters[-1]
        if last == "K":
            state = KEEP[state, INITIALS[code & 3]]
        elif last == "R":
            state = DUE[state]
    return out, state


def lines_of(letters: list[str], roles: list[str], texts: list[str], state: int, tail: bool) -> str | None:
    """The repaired rows ``role:text``, joined by line feeds; None if there is none. ``tail``: with what is due at the end."""
    out = []
    for edits, role, text in zip(letters, roles, texts, strict=True):
        for letter in edits:
            if letter == "D":
                continue
            if letter == "K":
                out.append(f"{role}:{text}")
                state = KEEP[state, role[:1]]
            else:
                out.append(f"{DUE_ROLE[state]}:{text if letter == 'R' else ''}")
                state = DUE[state]
    if tail:
        for _ in TAIL[state]:
            out.append(f"{DUE_ROLE[state]}:")
            state = DUE[state]
    return "\n".join(out) if out else None


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


_SUMMARY = "n long, lo long, hi long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long"


class _Segment:
    """Rows of one conversation as they come, in order."""

    def __init__(self, conv: str, conv_id: object, held_before: bool):
        self.conv, self.conv_id, self.later = conv, conv_id, held_before
        self.codes, self.roles, self.texts = bytearray(), [], []
        self.seen: set[tuple[str, str]] = set()
        self.fresh: list[int] = []
        self.chars = self.turns = self.illegal = 0
        self.lo = self.hi = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        bare = text.rstrip(BLANKS)
        if not bare:
            fault = BLANK
        elif (role, text) in self.seen:
            fault = DUPLICATE
        else:
            fault = NONE if bare[-1] in ".!?" else TRUNCATED
            self.seen.add((role, text))
            self.fresh.append(len(self.codes))
        if self.roles and self.roles[-1][:1] + role[:1] not in PAIRS:
            self.illegal += 1
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        self.codes.append(code_of(fault, role))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, part: int, seg: int, open_: bool) -> dict:
        faults = np.bincount(np.frombuffer(self.codes, np.uint8) >> 2, minlength=4)
        out = {
            "conv": self.conv, "conv_id": self.conv_id, "part": part, "seg": seg, "open": open_, "n": len(self.codes), "lo": self.lo, "hi": self.hi, "turns": self.turns,
            "first": self.roles[0][:1] if self.roles else None, "last": self.roles[-1][:1] if self.roles else None, "illegal": self.illegal,
            "blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]), "truncated": int(faults[TRUNCATED]),
        }
        if open_:
            digests = [_digest(self.roles[i], self.texts[i]) for i in self.fresh]
            return out | {"codes": bytes(self.codes), "fresh": self.fresh, "digests": digests, "roles": self.roles, "texts": self.texts}
        left, edits = backward(self.codes, FINAL)
        letters, end = follow(edits, self.codes, START)
        return out | {"cost": left[START], "audit": "".join(letters) + TAIL[end], "lines": lines_of(letters, self.roles, self.texts, START, True)}


def _segments(rows: DataFrame) -> DataFrame:
    """One row for each conversation solved in its task, and for each segment of the others (``open``)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv string, conv_id {kind}, part int, seg int, open boolean, {_SUMMARY}, cost long, audit string, lines string, codes binary, fresh array<int>, digests array<binary>, roles array<string>, texts array<string>"
    most_rows, most_chars = SEGMENT_ROWS, SEGMENT_CHARS

    def run(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        part, seg, now, first = TaskContext.get().partitionId(), 0, None, True
        out: list[dict] = []
        size = 0

        def close(open_: bool) -> None:
            nonlocal seg, size
            out.append(now.row(part, seg, open_))
            size += now.chars + len(now.codes)
            seg += 1

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                yield from pa.Table.from_pylist(out, arrow).to_batches()
                out.clear()
                size = 0

        for batch in batches:
            for conv, conv_id, turn, present, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "present", "role", "text")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(first or now.later)
                        first = False
                    now = _Segment(conv, conv_id, False)
                elif len(now.codes) >= most_rows or now.chars >= most_chars:
                    close(True)
                    now = _Segment(conv, conv_id, True)
                if present:
                    now.add(turn, role, text)
                if size > 1_000_000:
                    yield from ready()
        if now is not None:
            close(True)
        yield from ready()

    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ready = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", F.col("turn").cast("long"), "present",
        one("role").alias("role"), F.when(F.col("present"), one("text")).alias("text"), F.monotonically_increasing_id().alias("salt"),
    )
    keys = ["conv", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "salt"]
    ordered = ready.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return written(ordered.mapInArrow(lambda batches: run(batches, arrow), schema), "conversations")


def _repeated_later(segments: DataFrame) -> DataFrame:
    """(conv, part, seg, again): places of rows whose role and text stand in an earlier segment. A segment brings each text once."""
    texts = segments.select("conv", "part", "seg", F.explode(F.arrays_zip("fresh", "digests")).alias("t")).select("conv", "part", "seg", F.col("t.fresh").alias("i"), F.col("t.digests").alias("digest"))
    firsts = texts.groupBy("conv", "digest").agg(F.min(F.struct("part", "seg")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return texts.join(firsts, ["conv", "digest"]).where(F.struct("part", "seg") != F.col("first")).groupBy("conv", "part", "seg").agg(F.collect_list("i").alias("again"))


def _solve_open(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of the conversations that came in segments, and their repaired pieces."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    marked = segments.join(_repeated_later(segments), ["conv", "part", "seg"], "left")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, faults, costs = [], [], []
            for blob, again in zip(batch.column("codes").to_pylist(), batch.column("again").to_pylist(), strict=True):
                own = np.frombuffer(blob, np.uint8).copy()
                own[again or []] = DUPLICATE * 4 + (own[again or []] & 3)
                codes.append(own.tobytes())
                faults.append(np.bincount(own >> 2, minlength=4).tolist())
                costs.append([c for j in range(4) for c in backward(codes[-1], [0 if k == j else _FAR for k in range(4)])[0]])
            kept = [batch.column(c) for c in ("conv", "conv_id", "part", "seg", "n", "lo", "hi", "turns", "first", "last", "illegal")]
            counts = [pa.array([f[k] for f in faults], pa.int64()) for k in (BLANK, DUPLICATE, TRUNCATED)]
            yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array(codes, pa.binary()), pa.array(costs, pa.list_(pa.int64()))], ["conv", "conv_id", "part", "seg", "n", "lo", "hi", "turns", "first", "last", "illegal", "blank", "duplicate", "truncated", "codes", "costs"])

    slim = marked.select("conv", "conv_id", "part", "seg", "n", "lo", "hi", "turns", "first", "last", "illegal", "codes", "again")
    mapped = written(slim.mapInArrow(maps, f"conv string, conv_id {kind}, part int, seg int, {_SUMMARY}, codes binary, costs array<long>"), "conversation-maps")

    def from_right(group: pa.Table) -> pa.Table:
        """Costs at the right end of each segment, and the sums of the conversation with the first one."""
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seg"]))
        right: tuple[int, ...] = FINAL
        for r in reversed(rows):
            r["right"] = list(right)
            right = tuple(min(min(r["costs"][4 * j + i] + right[j], _FAR) for j in range(4)) for i in range(4))
        last, hi, lo, turns, illegal = None, None, None, 0, 0
        for r in rows:
            if r["n"]:
                illegal += r["illegal"] + int(last is not None and last + r["first"] not in PAIRS)
                last = r["last"]
            if r["lo"] is not None:
                turns += r["turns"] - int(r["lo"] == hi)
                lo, hi = r["lo"] if lo is None else lo, r["hi"]
        sums = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")} | {"gaps": 0 if lo is None else hi - lo + 1 - turns, "illegal": illegal, "cost": right[START]}
        names = ["conv", "conv_id", "part", "seg", "right", *sums]
        lists = [*[[r[c] for r in rows] for c in names[:5]], *[[v] + [None] * (len(rows) - 1) for v in sums.values()]]
        kinds = [pa.string(), group.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 6]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, lists, kinds, strict=True)})

    chained = written(
        mapped.drop("codes").groupBy("conv").applyInArrow(from_right, f"conv string, conv_id {kind}, part int, seg int, right array<long>, blank long, duplicate long, truncated long, gaps long, illegal long, cost long"),
        "conversation-costs",
    )

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, ends = [], []
            for codes, right in zip(batch.column("codes").to_pylist(), batch.column("right").to_pylist(), strict=True):
                edits = backward(codes, right)[1]
                blobs.append(np.array(edits, "<u2").tobytes())
                ends.append([follow(edits, codes, s)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "part", "seg", "codes")], pa.array(blobs, pa.binary()), pa.array(ends, pa.list_(pa.int32()))], ["conv", "part", "seg", "codes", "edits", "ends"])

    pointers = written(
        mapped.select("conv", "part", "seg", "codes").join(chained.select("conv", "part", "seg", "right"), ["conv", "part", "seg"]).mapInArrow(spill, "conv string, part int, seg int, codes binary, edits binary, ends array<int>"),
        "conversation-pointers",
    )

    def from_left(group: pa.Table) -> pa.Table:
        rows, state = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seg"])), START
        for r in rows:
            r["state"], state = state, r["ends"][state]
        return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in (("conv", pa.string()), ("part", pa.int32()), ("seg", pa.int32()), ("state", pa.int32()))} | {"final": pa.array([i == len(rows) - 1 for i in range(len(rows))])})

    states = pointers.select("conv", "part", "seg", "ends").groupBy("conv").applyInArrow(from_left, "conv string, part int, seg int, state int, final boolean")
    ready = segments.select("conv", "conv_id", "part", "seg", "roles", "texts").join(pointers.drop("ends"), ["conv", "part", "seg"]).join(states, ["conv", "part", "seg"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, lines = [], []
            for codes, blob, state, final, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "edits", "state", "final", "roles", "texts")), strict=True):
                letters, end = follow(np.frombuffer(blob, "<u2").tolist(), codes, state)
                audits.append("".join(letters) + (TAIL[end] if final else ""))
                lines.append(lines_of(letters, roles, texts, state, final))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "conv_id", "part", "seg")], pa.array(audits, pa.string()), pa.array(lines, pa.string())], ["conv", "conv_id", "part", "seg", "audit", "lines"])

    pieces = written(ready.mapInArrow(finish, f"conv string, conv_id {kind}, part int, seg int, audit string, lines string"), "conversation-pieces")
    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seg", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    return chained.where("cost IS NOT NULL").drop("right", "part", "seg").join(audits, "conv"), pieces


@dataclass
class Repair:
    """``conversations``: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation. ``pieces``: its repaired
    rows as text (conv, conv_id, part, seg, lines; null: no rows), one piece where ``whole``, else several to be read in the order of (part, seg).
    """

    conversations: DataFrame
    pieces: DataFrame


def repair_conversations(rows: DataFrame) -> Repair:
    """Faults and cheapest edits of every conversation in ``rows`` (conv_id, turn, role, text, present).

    Rows that are not ``present`` only name their conversation. Null roles and texts count as one space. Rows without a
    conv_id are one conversation; rows without a turn come first; rows of one turn go by role and text (its first 64 characters, then
    a hash of all). Rows repeated stay each. A role without letters, or with another initial than s, u and a, cannot be kept.
    """
    segments = _segments(rows)
    done, several = segments.where("NOT open"), segments.where("open")
    results, pieces = _solve_open(several)
    columns = ["conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    solved = done.withColumn("gaps", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)))
    every = done.select("conv", "conv_id", "part", "seg", "lines", F.lit(True).alias("whole")).union(pieces.select("conv", "conv_id", "part", "seg", "lines", F.lit(False)))
    return Repair(solved.select(columns).union(results.select(columns)), every)


def text_digests(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of each conversation's repaired text. Pieces of one conversation are read in order, one at a time."""
    whole = pieces.where("whole").select("conv", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, state = None, False, hashlib.sha256()
        made: list[tuple[str, str]] = []
        for batch in batches:
            for conv, lines in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if conv != now:
                    if now is not None:
                        made.append((now, state.hexdigest()))
                    now, some, state = conv, False, hashlib.sha256()
                if lines is not None:
                    state.update((("\n" if some else "") + lines).encode())
                    some = True
        if now is not None:
            made.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.string()), pa.array([d for _, d in made], pa.string())], ["conv", "repaired_sha256"])

    parts = pieces.where("NOT whole").select("conv", "part", "seg", "lines").repartition("conv").sortWithinPartitions("conv", "part", "seg")
    return whole.union(parts.mapInArrow(run, "conv string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults planted by a hash of conversation and turn: a row dropped, emptied, without its marks, repeated, or given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", (kind != 0).alias("present"), F.when(kind == 4, "user").otherwise(one("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _sql() -> str:
    """The query in DuckDB: the same recursion from the last row to the first, with whole strings instead of pointers."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)), lambda i: ascii(k[i + 1])::BIGINT)), lambda x, y: "
        "list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
    )
    one = lambda c, a, t: f"{{'c': ({c})::BIGINT, 'a': {a}, 't': {t}}}"
    own, best = [], []
    for s in range(4):
        options = [one(f"v[{s + 1}].c + 2", f"'D' || v[{s + 1}].a", f"v[{s + 1}].t")]
        to = DUE[s] + 1
        options.append(f"CASE WHEN fault < 2 THEN {one(f'v[{to}].c + 1 + extra', f"""'R' || v[{to}].a""", f"""chr(10) || '{DUE_ROLE[s]}:' || text || v[{to}].t""")} END")
        for (state, initial), after in KEEP.items():
            if state == s:
                options.append(f"CASE WHEN fault < 2 AND role[1] = '{initial}' THEN {one(f'v[{after + 1}].c + extra', f"""'K' || v[{after + 1}].a""", f"""chr(10) || role || ':' || text || v[{after + 1}].t""")} END")
        own.append(f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]")
        inserted = one(f"w[{to}].c + 5", f"'I' || w[{to}].a", f"chr(10) || '{DUE_ROLE[s]}:' || w[{to}].t")
        best.append(f"list_sort([w[{s + 1}], {inserted}])[1]")
    ends = ", ".join([one("0", "''", "''"), one("10", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), one("5", "'I'", "chr(10) || 'assistant:'"), one("0", "''", "''")])
    blanks = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, unnest(CASE d WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
    CASE WHEN NOT regexp_matches(text, '[^{blanks}]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
      WHEN regexp_extract(text, '([^{blanks}])[{blanks}]*$', 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
  FROM placed
),
priced AS (SELECT *, CASE WHEN fault = 1 THEN 5 ELSE 0 END AS extra FROM judged),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
walked(conv_id, i, v) AS (
  SELECT conv_id, n + 1, [{ends}] FROM counted
  UNION ALL
  SELECT conv_id, i, [{', '.join(best)}] FROM (SELECT p.conv_id, p.i, [{', '.join(own)}] AS w FROM walked JOIN priced p ON p.conv_id IS NOT DISTINCT FROM walked.conv_id AND p.i = walked.i - 1)
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(v[1].t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN walked w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = 1
"""


SQL = _sql()
