"""Merkle manifest of a dataset with one shared proof for each partition of leaves (operator 12).

Every row is a leaf: the digest of its fields with their lengths. Each language has a tree of its own over its leaves in the order of
doc_id; the roots of these trees are the leaves of the top tree. Positions come from a range sort and the row counts of the
sorted parts, so a language of any size is spread over many tasks. Trees are built in bands of ``bits`` levels: a task gets 2 ** bits
neighbouring nodes of one band and returns all nodes above them; the next band starts from what is left.

Proofs are made for whole blocks of leaves. A block works out the coordinates of the nodes that none of its own leaves yield,
the smallest such set for all of its leaves together, and they are fetched once, by a join. The block then derives the nodes
that its leaves share and expands the proof of each leaf from them, without further reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

#: Levels of a tree that one task builds at a time; 2 ** BITS nodes are what it holds.
BITS = 12
#: The name of the top tree; those of the languages are empty (no language) or begin with an equals sign.
TOP = "#"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """Digest of the fields: ``-`` for null, else the length in bytes, a colon and the value."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def depth_of(n: int) -> int:
    """Levels above the leaves of a tree with n leaves."""
    return max(n - 1, 0).bit_length()


def _count(n: int, level: int) -> int:
    """Nodes at a level of a tree with n leaves."""
    return -(-n >> level)


def numbered(df: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """Add ``pos``, the 0-based position inside ``tree`` in ``order``, and ``n``, the rows of the tree; equal rows in any order.

    One range shuffle; the parts are numbered where they are, and only one count for each part and tree is added up.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pa.compute.run_end_encode(batch.column(tree))
            ends, out = runs.run_ends.to_numpy(), []
            for begin, end, name in zip([0, *ends[:-1]], ends, runs.values.to_pylist(), strict=True):
                if name != last:
                    last, held = name, 0
                out.append(np.arange(held, held + end - begin))
                held += int(end - begin)
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(np.concatenate(out))], [*batch.schema.names, "part", "i"])

    keys = [tree, *order, "_salt"]
    ranged = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "part int, i long"])
    placed = written(ranged.mapInArrow(number, schema), label)
    own = Window.partitionBy(tree)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(tree, "part").agg(F.count("*").alias("rows"))
    bases = written(counts.select(tree, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(own).alias("n")), f"{label}-bases")
    return placed.join(bases, [tree, "part"]).withColumn("pos", F.col("base") + F.col("i")).drop("part", "i", "base")


@dataclass
class Manifest:
    """``leaves``: one row for each document (tree, pos, n, doc_id, leaf and what was carried along). ``bands``: nodes (tree, level,
    idx, digest) of each band of levels, the leaves of a tree in the first. ``trees``: place of each tree in the top tree
    (tree, n, top_pos, top_n, subroot). ``root``: the digest of everything, None for an empty table.
    """

    leaves: DataFrame
    bands: list[DataFrame]
    trees: DataFrame
    root: str | None
    bits: int


def _levels(below: DataFrame, start: int, bits: int) -> DataFrame:
    """Nodes of the levels start + 1 to start + bits from the nodes (tree, idx, digest, n) of level ``start``."""

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("idx").to_numpy())
        nodes = group.column("digest").take(order).to_pylist()
        tree, n = group.column("tree")[0].as_py(), group.column("n")[0].as_py()
        first = int(group.column("idx").to_numpy().min())
        levels, places, digests = [], [], []
        for level in range(start + 1, min(start + bits, depth_of(n)) + 1):
            nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            first >>= 1
            levels += [level] * len(nodes)
            places += range(first, first + len(nodes))
            digests += nodes
        return pa.table({"tree": pa.array([tree] * len(levels), pa.string()), "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string()), "n": pa.array([n] * len(levels), pa.int64())})

    blocks = below.select("tree", "idx", "digest", "n", F.shiftright("idx", bits).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(build, "tree string, level int, idx long, digest string, n long")


def _grow(leaves: DataFrame, bits: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All nodes of the trees over ``leaves`` (tree, pos, n, leaf) in bands of levels, and the roots (tree, n, digest)."""
    low = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "n")
    deepest = depth_of(leaves.agg(F.max("n")).first()[0] or 0)
    bands, roots, start = [], low.where("n = 1"), 0
    while start < deepest:
        made = written(_levels(low.where(F.col("n") > 1 << start), start, bits), f"{label}-{start}")
        bands.append(made if start else low.union(made))
        roots = roots.union(made.where(F.col("idx") == 0).where(F.col("level") == F.length(F.bin(F.col("n") - 1))))
        start += bits
        low = made.where(F.col("level") == start)
    return bands or [low], roots.select("tree", "n", "digest")


def build_manifest(docs: DataFrame, carried: dict[str, Column] | None = None, bits: int = BITS) -> Manifest:
    """Trees of all rows. Null fields count as such; null languages are a tree of their own, which comes first.

    Inside a language, rows without doc_id come first and rows with the same doc_id go by their leaf digest; repeated rows are leaves
    each. An empty table has no root. ``carried``: more columns of the leaves, from the columns of ``docs``.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("leaf"), *[c.alias(name) for name, c in (carried or {}).items()])
    leaves = numbered(rows, "tree", ["doc_id", "leaf"], "manifest-leaves")
    bands, roots = _grow(leaves, bits, "manifest-nodes")
    subroots = written(roots.withColumnRenamed("n", "own_n").select(F.lit(TOP).alias("top"), F.col("tree").alias("name"), "own_n", F.col("digest").alias("leaf")), "manifest-subroots")
    tops = numbered(subroots, "top", ["name"], "manifest-trees").withColumnRenamed("top", "tree")
    top_bands, top_roots = _grow(tops, bits, "manifest-top")
    bands = [a.union(b) for a, b in zip(bands, top_bands, strict=False)] + bands[len(top_bands) :] + top_bands[len(bands) :]
    trees = tops.select(F.col("name").alias("tree"), F.col("own_n").alias("n"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.col("leaf").alias("subroot"))
    root = top_roots.first()
    return Manifest(leaves, bands, trees, root.digest if root else None, bits)


def missing_nodes(positions: list[int], n: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that the proofs of the leaves at ``positions`` need and that these leaves do not yield; the fewest
    that do. A node is missing if its neighbour is on a path and it is not."""
    out, known = [], sorted(set(positions))
    for level in range(depth_of(n)):
        have, last = set(known), _count(n, level)
        out += [(level, i ^ 1) for i in known if i ^ 1 not in have and i ^ 1 < last]
        known = sorted({i >> 1 for i in known})
    return out


def interior(positions: list[int], leaves: list[str], n: int, fetched: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """Every node that stands on or beside the paths of the given leaves: what was fetched and what follows from both."""
    nodes = {**fetched, **{(0, i): d for i, d in zip(positions, leaves, strict=True)}}
    known = sorted(set(positions))
    for level in range(depth_of(n)):
        known = sorted({i >> 1 for i in known})
        last = _count(n, level)
        for i in known:
            nodes[level + 1, i] = digest(*[nodes[level, c] for c in (2 * i, 2 * i + 1) if c < last])
    return nodes


def siblings(position: int, n: int, node: Callable[[int, int], str]) -> list[tuple[str, bool]]:
    """(digest, stands on the left) at each level, an empty digest where the node is alone."""
    out = []
    for level in range(depth_of(n)):
        i = (position >> level) ^ 1
        out.append((node(level, i) if i < _count(n, level) else "", bool(i & 1 ^ 1)))
    return out


def fold(leaf: str, path: list[tuple[str, bool]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for other, left in path:
        leaf = digest(other, leaf) if left else digest(leaf, other)
    return leaf


def prove(manifest: Manifest, claims: DataFrame, claim: str = "leaf") -> DataFrame:
    """Proof of each row of ``claims``, any selection of the manifest's leaves (all their columns).

    Adds subroot, root, proof (digests from the leaf to the root, in order), folded_root (what column ``claim``, a digest, yields with that
    proof) and verified (equal to the root of the manifest). One fetch for each block of leaves, of the fewest nodes.
    """
    bits, root = manifest.bits, manifest.root
    wanted = claims.withColumn("block", F.shiftright("pos", bits))

    def coordinates(group: pa.Table) -> pa.Table:
        tree, n, number = (group.column(c)[0].as_py() for c in ("tree", "n", "block"))
        own = [(-1, 0), *missing_nodes(group.column("pos").to_pylist(), n)]  # the first row stands for the block
        kinds = {"tree": pa.string(), "block": pa.int64(), "level": pa.int32(), "idx": pa.int64()}
        return pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), ([tree] * len(own), [number] * len(own), [level for level, _ in own], [i for _, i in own]), strict=True)})

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, pos, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "top_pos", "top_n")), strict=True):
                own = missing_nodes([pos], n)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own), pa.string()), pa.array([level for level, _ in own], pa.int32()), pa.array([i for _, i in own], pa.int64())], ["tree", "level", "idx"])

    def fetch(needs: DataFrame, at: Column) -> DataFrame:
        """``needs`` with the digests of their coordinates in tree ``at``; only bands that are asked for are read."""
        # band 0 holds the levels 0 to bits, each later one the next ``bits`` levels
        band = F.greatest(F.lit(0), F.floor((F.col("level") - 1) / F.lit(bits)))
        out = None
        for k in sorted(r.band for r in needs.select(band.alias("band")).distinct().collect()):
            nodes = manifest.bands[k].select(F.col("tree").alias("at"), "level", "idx", "digest")
            found = needs.where(band == k).withColumn("at", at).join(nodes, ["at", "level", "idx"]).select(*needs.columns, "digest")
            out = found if out is None else out.union(found)
        return out if out is not None else needs.withColumn("digest", F.lit(""))

    asked = wanted.select("tree", "block", "pos", "n").groupBy("tree", "block").applyInArrow(coordinates, "tree string, block long, level int, idx long")
    needs = written(asked, "manifest-missing")
    blocks = needs.where("level < 0").select("tree", "block")
    upper = written(manifest.trees.select("tree", "top_pos", "top_n").mapInArrow(above, "tree string, level int, idx long"), "manifest-above")
    tops = fetch(upper, F.lit(TOP)).groupBy("tree").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("tops"))
    # one row of a block brings its place in the top tree, with the path from there on
    heads = blocks.join(manifest.trees.select("tree", "top_pos", "top_n"), "tree").join(tops, "tree", "left").select("tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit("").alias("digest"), "top_pos", "top_n", "tops")
    none = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("top_pos", "top_n", "tops")]
    fetched = written(heads.union(fetch(needs.where("level >= 0"), F.col("tree")).select("tree", "block", "level", "idx", "digest", *none)), "manifest-fetched")

    def expand(group: pa.Table, union: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        got, upper = {}, []
        for row in union.to_pylist():
            if row["level"] >= 0:
                got[row["level"], row["idx"]] = row["digest"]
            else:
                top = {(t["level"], t["idx"]): t["digest"] for t in row["tops"] or []}
                upper = siblings(row["top_pos"], row["top_n"], lambda level, i, top=top: top[level, i])
        positions = group.column("pos").to_pylist()
        nodes = interior(positions, group.column("leaf").to_pylist(), n, got)
        subroot = nodes[depth_of(n), 0]
        paths = [siblings(p, n, lambda level, i: nodes[level, i]) + upper for p in positions]
        folded = [fold(d, path) for d, path in zip(group.column(claim).to_pylist(), paths, strict=True)]
        added = {
            "subroot": pa.array([subroot] * len(paths), pa.string()),
            "root": pa.array([root] * len(paths), pa.string()),
            "proof": pa.array(["".join(d for d, _ in path) for path in paths], pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
        kept = group.select([c for c in group.schema.names if c != "block"])
        return pa.table({**{c: kept.column(c) for c in kept.schema.names}, **added})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in claims.select("tree", *[c for c in claims.columns if c != "tree"]).schema]
    schema = ", ".join([*fields, "subroot string, root string, proof string, folded_root string, verified boolean"])
    return wanted.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


def tampered(doc_id: Column) -> Column:
    """Rows that the query claims with one character more than they have."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


#: The query in DuckDB, which keeps the levels of a tree as lists.
SQL = """
WITH RECURSIVE
fields AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)),
      lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc
  FROM documents
),
hashed AS (SELECT doc_id, tree, sha256(head || chars || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS claim FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
grown(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM grown WHERE len(nodes) > 1
),
trees AS (SELECT tree, list(nodes ORDER BY level) AS levels, max_by(nodes, level)[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM grown GROUP BY tree),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM trees
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM top WHERE len(nodes) > 1
),
whole AS (SELECT list(nodes ORDER BY level) AS levels, max_by(nodes, level)[1] AS root FROM top),
paths AS (
  SELECT l.doc_id, l.leaf, l.claim, t.subroot, w.root,
    list_concat(
      list_transform(range(len(t.levels) - 1), lambda k: CASE WHEN xor(l.pos >> k, 1) >= len(t.levels[k + 1]) THEN 'N' ELSE (CASE WHEN (l.pos >> k) & 1 = 1 THEN 'L' ELSE 'R' END) || t.levels[k + 1][xor(l.pos >> k, 1) + 1] END),
      list_transform(range(len(w.levels) - 1), lambda k: CASE WHEN xor(t.pos >> k, 1) >= len(w.levels[k + 1]) THEN 'N' ELSE (CASE WHEN (t.pos >> k) & 1 = 1 THEN 'L' ELSE 'R' END) || w.levels[k + 1][xor(t.pos >> k, 1) + 1] END)
    ) AS path
  FROM leaves l JOIN trees t USING (tree), whole w
),
folded AS (
  SELECT *, list_reduce(list_prepend(claim, path), lambda x, y: CASE y[1] WHEN 'L' THEN sha256(y[2:] || x) WHEN 'R' THEN sha256(x || y[2:]) ELSE sha256(x) END) AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
