import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash

DOCS = "doc_id long, text string, fp string, component_id string, cell string"


def plain_fingerprint(text, size=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least place reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def clustered(rng, n):
    """Fingerprints with chains and dense groups among unrelated ones."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            out.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    return list(dict.fromkeys(out))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 3)
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "two Words", "É à b c D\x0be", "x" * 5000] + [" ".join(rng.choice("ab cd EF g".split()) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    for t in texts:
        assert int.from_bytes(simhash.fingerprint(t), "big") == plain_fingerprint(t), t


def test_allocation_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        costs = [[rng.random() * 9 ** (t + 1) for t in range(5)] for _ in range(rng.randrange(2, 6))]

        def every(k, left):
            if k == len(costs):
                return [(0.0, [])] if left == 0 else []
            return [(c + (costs[k][t] if t >= 0 else 0), [t, *r]) for t in range(-1, left) for c, r in every(k + 1, left - t - 1)]

        assert simhash.allocate(costs, 4)[0] == pytest.approx(min(every(0, 5))[0])


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    x = (x & np.uint64((1 << 48) - 1)) | (x & np.uint64(0xFFFF)) << np.uint64(48)  # the top 16 bits repeat the low ones
    masks = simhash.grouped_bits(x, 4)
    assert sum(masks) == (1 << 64) - 1 and [m.bit_count() for m in masks] == [16] * 4
    assert sum(any(m >> b & 1 and m >> (b + 48) & 1 for m in masks) for b in range(16)) >= 12


@pytest.mark.parametrize("thresholds", [[0, 0, 0, 0, 0], [1, 0, 0, 0], [2, 0, -1, 1], [2, 1]])
@pytest.mark.parametrize("cell", [4096, 4])
def test_no_tie_is_lost(spark, monkeypatch, thresholds, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    prints = clustered(rng, 400)
    plan = simhash.Plan(simhash.grouped_bits(np.array(prints, np.uint64), len(thresholds)), thresholds)
    if len(thresholds) == 2:
        plan = simhash.Plan([(1 << 20) - 1 << 44, (1 << 44) - 1], [0, 3]) if cell == 4 else simhash.Plan([(1 << 54) - 1, (1 << 10) - 1 << 54], [1, 2])
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    if len(thresholds) == 2 and cell == 4:
        df, prints = df.limit(40), prints[:40]
        prints = [int(np.int64(r.fp).view(np.uint64)) for r in df.collect()]
        df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    ties = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.near_ties(df, plan, 4).collect()]
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in ties:
        x, y = find(place[u]), find(place[v])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(80, 300))]
        rows.append((3 * i, " ".join(body), "", "", ""))
        body[rng.randrange(len(body))] = "changed"
        rows.append((3 * i + 1, " ".join(body).upper(), "", "", ""))
    rows += [(-7, None, "", "", ""), (500, "", "", "", ""), (500, "", "", "", ""), (None, rows[0][1], "", "", ""), (None, "alone without a number", "", "", ""), (900, "word " * 50_000, "", "", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = simhash.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(prints)
    least = {}
    for (d, *_), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, p, least.get(r)) for (d, *_), p, r in zip(rows, prints, roots, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted([(r.doc_id, int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
