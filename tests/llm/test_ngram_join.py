import random

import numpy as np
import pytest

from ledgerlens.llm import ngram_join
from ledgerlens.llm.ngram_join import ngram_components, trie_components

SCHEMA = "doc_id long, text string, node int"


def sets_of(text, size):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "").translate({i: " " for i in range(9, 14)})).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(d, sets_of(t, size)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, groups, words=60):
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, words, 4 * words]))]
        if g % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(own)))
    return rows


def test_trie_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.sample(range(200), rng.randrange(1, 40)) for _ in range(4)]
        sets = [np.unique([v if rng.random() > 0.05 else rng.randrange(300) for v in rng.choice(base)]).astype(np.uint64) for _ in range(25)]
        names = np.array(rng.sample(range(1000), 25), np.int64)
        got = trie_components(names, sets, 80)
        root = {n: n for n in names.tolist()}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    x, y = sorted((find(int(names[i])), find(int(names[j]))))
                    root[y] = x
        assert got.tolist() == [find(n) for n in names.tolist()]


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", block)
    rows = corpus(5, 90) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c"), (1006, "a b c d")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, ngram_components(df, 4, 85).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(rows, 4, 85)


def test_empty_repeated_and_missing_ids(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "one two three four five six"
    df = spark.createDataFrame([(4, text, 0), (4, text, 0), (2, text, 0), (None, text, 0), (9, "x" * 300_000, 0)], SCHEMA)
    got = [tuple(r) for r in ngram_components(df).collect()]
    assert sorted(got, key=repr) == sorted([(4, 2, 2), (4, 2, 2), (2, 2, 2), (None, 2, None), (9, 1, 9)], key=repr)
