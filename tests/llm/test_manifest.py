import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, n string, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


def expected(rows):
    """(doc_id, leaf, subroot, root, proof) of every row from whole trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([d for _, d in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        ids = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(d, h, trees[g][-1][0], top[-1][0], "".join(path(trees[g], i) + path(top, k))) for i, (d, h) in enumerate(ids)]
    return out


def rows_of(rng, n):
    langs = [None, "en", "en", "en", "", "é", "z", "Z"]
    out = [(rng.choice([None, rng.randrange(-500, 500)]) if rng.random() < 0.1 else i, rng.choice([None, "s", "ü"]), rng.choice(langs), rng.choice([None, 9, 99]), rng.choice([None, "", "né " * rng.randrange(9)]), "", "", "", "") for i in range(n)]
    return out + out[:3]


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
@pytest.mark.parametrize("n", [0, 1, 2, 70])
def test_manifest_equals_whole_trees(spark, bits, n):
    rows = rows_of(random.Random(n), n) if n else []
    made = manifest.build_manifest(spark.createDataFrame(rows, DOCS).repartition(5), bits=bits)
    got = manifest.prove(made, made.leaves).collect()
    want = expected(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=key) == sorted(want, key=key)
    assert all(r.verified and r.folded_root == made.root for r in got)
    assert made.root == (want[0][3] if want else None)


@pytest.mark.parametrize("share", [7, 2])
def test_proofs_of_a_selection(spark, share):
    rows = [(i, "s", "en" if i % 3 else "fr", 5, f"text {i}", "", "", "", "") for i in range(90)]
    made = manifest.build_manifest(spark.createDataFrame(rows, DOCS), {"changed": manifest.leaf_digest(n_chars=F.col("n_chars") + 1)}, bits=3)
    some = made.leaves.where(F.col("doc_id") % share == 0)
    want = {w[0]: w for w in expected(rows)}
    got = manifest.prove(made, some).collect()
    assert {r.doc_id for r in got} == {i for i in range(90) if i % share == 0}
    assert all((r.doc_id, r.leaf, r.subroot, r.root, r.proof) == want[r.doc_id] and r.verified for r in got)
    assert not any(r.verified for r in manifest.prove(made, some, "changed").collect())


def test_missing_nodes_are_the_fewest():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 40)
        some = rng.sample(range(n), rng.randrange(1, n + 1))
        tree = levels([sha(str(i)) for i in range(n)])
        needed = {(level, (p >> level) ^ 1) for p in some for level in range(len(tree) - 1) if (p >> level) ^ 1 < len(tree[level])}
        derived = {(level, p >> level) for p in some for level in range(len(tree))}
        missing = manifest.missing_nodes(some, n)
        assert sorted(missing) == sorted(needed - derived)
        nodes = manifest.interior(sorted(some), [tree[0][i] for i in sorted(some)], n, {(level, i): tree[level][i] for level, i in missing})
        assert nodes[len(tree) - 1, 0] == tree[-1][0]
        for p in some:
            sides = manifest.siblings(p, n, lambda level, i: nodes[level, i])
            assert [d for d, _ in sides if d] == path(tree, p) and manifest.fold(tree[0][p], sides) == tree[-1][0]
