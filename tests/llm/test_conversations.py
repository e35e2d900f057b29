import hashlib
import heapq
import random
import re
from collections import defaultdict

import pytest

from ledgerlens.llm import conversations as conv

ROWS = "conv_id long, turn long, role string, text string, present boolean, audit string, lines string, part string"
ROLE = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, letters, text) over all edits: every sequence is tried, cheapest first, inserts anywhere."""
    queue, settled = [(0, "", 0, "", "")], {}
    while queue:
        cost, letters, i, initials, text = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, text
        state = (i, initials[-1:])
        if (cost, letters) > settled.get(state, (cost, letters)) and cost > settled[state][0]:
            continue
        settled.setdefault(state, (cost, letters))

        def go(price, letter, at, role, body, cost=cost, letters=letters, initials=initials, text=text):
            grown = initials + role[:1] if role else initials
            if re.fullmatch("s?(ua)*u?", grown):
                heapq.heappush(queue, (cost + price, letters + letter, at, grown, text + f"\n{role}:{body}" if role else text))

        for role in ROLE.values():
            if letters[-2:] != "II":
                go(5, "I", i, role, "")
        if i < len(rows):
            _, role, body = rows[i]
            go(2, "D", i + 1, None, "")
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] else 0
                if role[:1] in ("s", "u", "a") and role[:1]:
                    go(extra, "K", i + 1, role, body)
                for other in ROLE.values():
                    go(1 + extra, "R", i + 1, other, body)
    raise AssertionError


def expected(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text, present, *_ in rows:
        groups[conv_id] += [(turn, " " if role is None else role, " " if text is None else text)] if present else []
    out = {}
    for name, some in groups.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found, turns = faults(some), [t for t, *_ in some if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters, text = cheapest(some, found)
        out[name] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text[1:].encode()).hexdigest())
    return out


def made(rng, n, most):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "ub"])
            text = rng.choice(["Fine.", "Fine.", "why?", "cut", " \t", "", None, f"row {c} {t}!", "é "])
            rows.append((None if c == 3 else c, rng.choice([t, t, t, t, None, 2 * t]), role, text, rng.random() < 0.9, "", "", ""))
    return rows


@pytest.mark.parametrize("limit", [50_000, 3])
def test_equals_the_search_of_all_edits(spark, monkeypatch, limit):
    monkeypatch.setattr(conv, "SEGMENT_ROWS", limit)
    rows = made(random.Random(limit), 60, 9) + [(1000, t, "user" if t % 2 else "assistant", f"t {t % 7}.", True, "", "", "") for t in range(30)] + [(1001, 5, "user", "x.", False, "", "", "")]
    found = conv.repair_conversations(spark.createDataFrame(rows, ROWS).repartition(6))
    digests = {r.conv: r.repaired_sha256 for r in conv.text_digests(found.pieces).collect()}
    results = found.conversations.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv]) for r in results}
    want = expected(rows)
    assert len(results) == len(want) == len(digests)
    for name, w in want.items():
        assert got[name] == w, (name, [r for r in rows if r[0] == name])


def test_letters_and_costs_agree_with_the_search():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for i in range(rng.randrange(0, 7))]
        found = faults(rows)
        codes = bytes(conv.code_of({"": 0, "truncated": 1, "blank": 2, "duplicate": 3}[f], r[1]) for r, f in zip(rows, found, strict=True))
        left, edits = conv.backward(codes, conv.FINAL)
        letters, end = conv.follow(edits, codes, conv.START)
        cost, best, text = cheapest(rows, found)
        assert (left[0], "".join(letters) + conv.TAIL[end]) == (cost, best)
        assert (conv.lines_of(letters, [r[1] for r in rows], [r[2] for r in rows], 0, True) or "") == text[1:]


def test_empty_and_long(spark):
    empty = conv.repair_conversations(spark.createDataFrame([], ROWS))
    assert empty.conversations.count() == 0 and conv.text_digests(empty.pieces).count() == 0
    rows = [(1, 0, "user", "long " * 400_000 + ".", True, "", "", ""), (1, 1, "assistant", "ok.", True, "", "", "")]
    found = conv.repair_conversations(spark.createDataFrame(rows, ROWS))
    assert [r.audit for r in found.conversations.collect()] == ["KK"]
    assert [r.repaired_sha256 for r in conv.text_digests(found.pieces).collect()] == [hashlib.sha256(f"user:{rows[0][3]}\nassistant:ok.".encode()).hexdigest()]


def test_damage(spark):
    import zlib

    rows = [(c, t, "system", "A. b! c?", True, "", "", "") for c in range(40) for t in range(5)] + [(None, None, None, None, True, "", "", "")]
    got = defaultdict(list)
    for r in conv.damaged(spark.createDataFrame(rows, ROWS)).collect():
        got[r.conv_id, r.turn].append((r.present, r.role, r.text))
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        assert got[c, t] == [(kind != 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
