"""Similarity join of n-gram sets with a prefix tree (operator 5).

1. Every row gets its set of word n-grams (64-bit hashes), a digest of the set, and a prefix: the least hashes, twice as many as a
   partner may lack. Two sets that link have a known number of hashes in common inside their prefixes.
2. Prefix hashes meet in buckets; a row stays only if enough of its prefix also stands in other rows. Within a
   task equal hashes are combined first, so that a hash of a third of all rows costs a bucket one entry per task.
3. Rows with equal sets are one class. The rarest hashes of a class that a partner cannot all lack tie classes to candidate groups.
4. In each group the whole sets, ordered by frequency, form a trie. It is walked once for all sets together: the
   overlaps of a shared path are counted once, and a subtree is left out for sets whose remaining length cannot reach the bound
   or that are in its component already. A group too large for one task is dealt out in pairs of blocks of similar length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, slices, written
from ledgerlens.llm.kernels import Words, shingles

#: Hashes that a task holds at a time, about: entries of a bucket, and tokens of a block of sets.
BUCKET_HASHES = 2_000_000
BLOCK_HASHES = 4_000_000
#: Entries of a bucket: rows known to share their hash, rows that may, and hashes that several rows of a task have (they go on once).
RESOLVED, OPEN, SEEN = 0, 1, 2


def _least(n: int, percent: int) -> int:
    """``percent`` per cent of n, rounded up."""
    return (n * percent + 99) // 100


def ngram_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (n-grams in the set), digest of the set and prefix (its least hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, starts = shingles(Words(batch.column("text")), size)
            counts, digests, prefixes = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = np.unique(hashes[a:b])
                n = len(own)
                counts.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                prefixes.append(own[: n - _least(n, percent) + _least(n, 100 - percent)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "n", "digest", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, digest binary, prefix binary")


def shared_hashes(sets: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, token): each hash of a row's prefix that stands in another row's prefix too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(docs: np.ndarray, hashes: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            bucket = (docs.view(np.uint64) if kind == RESOLVED else hashes >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edges))
            parts = [order[edges[b] : edges[b + 1]] for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([docs[p].tobytes() for p in parts], pa.binary()), pa.array([hashes[p].tobytes() for p in parts], pa.binary())],
                ["bucket", "kind", "docs", "hashes"],
            )

        def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            docs, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, count = np.unique(hashes, return_index=True, return_counts=True)
            one = np.zeros(len(hashes), bool)
            one[at[count == 1]] = True
            yield from rows(docs[~one], hashes[~one], RESOLVED)
            yield from rows(docs[one], hashes[one], OPEN)
            many = at[count > 1]
            yield from rows(docs[many], hashes[many], SEEN)

        held, size = [], 0
        for batch in slices(batches, "prefix", 1_000_000):
            prefix = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            held.append((np.repeat(batch.column("doc_id").to_numpy(), [len(p) for p in prefix]), np.concatenate(prefix)))
            size += len(held[-1][0])
            if size >= 1_000_000:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def meet(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        docs = [np.frombuffer(d, np.int64) for d in group.column("docs").to_pylist()]
        hashes = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
        done = [(d, h) for d, h, k in zip(docs, hashes, kinds, strict=True) if k == RESOLVED]
        left = [(d, h, np.full(len(d), k == OPEN)) for d, h, k in zip(docs, hashes, kinds, strict=True) if k != RESOLVED]
        if left:
            d, h, open_ = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.argsort(h, kind="stable")
            d, h, open_ = d[order], h[order], open_[order]
            same = h[1:] == h[:-1]
            keep = np.zeros(len(h), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep &= open_
            done.append((d[keep], h[keep]))
        d, h = (np.concatenate(x) for x in zip(*done, strict=True))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "token": pa.array(h.view(np.int64))})

    dealt = sets.select("doc_id", "prefix").mapInArrow(deal, "bucket int, kind int, docs binary, hashes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "doc_id long, token long")


def trie_components(names: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least name in the component of each set; sets link from ``percent`` per cent Jaccard similarity on.

    ``sets`` hold different numbers each. One walk over the trie of all sets; ``overlap`` counts, for every set at once, what
    it has in common with the path so far.
    """
    k = len(sets)
    labels = names.copy()
    size = np.array([len(s) for s in sets], np.int64)
    if k < 2:
        return labels
    owner = np.repeat(np.arange(k), size)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank_of = np.full(len(values), -1, np.int64)
    frequent = np.flatnonzero(counts > 1)
    frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
    rank_of[frequent] = np.arange(len(frequent))
    ranks = rank_of[inverse]
    owner, ranks = owner[ranks >= 0], ranks[ranks >= 0]
    order = np.lexsort((ranks, owner))
    owner, ranks = owner[order], ranks[order]
    row = np.searchsorted(owner, np.arange(k + 1))
    keys = owner * (len(frequent) + 1) + ranks  # for counting what a set has after a rank
    by_rank = np.argsort(ranks, kind="stable")
    postings, post = owner[by_rank], np.searchsorted(ranks[by_rank], np.arange(len(frequent) + 1))
    paths = [ranks[row[i] : row[i + 1]] for i in range(k)]
    sorted_sets = sorted(range(k), key=lambda i: paths[i].astype(">u4").tobytes())

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    # inner nodes of the trie: [depth, first set, last set, children], leaves are numbers
    root: list = [0, 0, k - 1, []]
    open_nodes, leaf = [root], 0
    for i in range(1, k + 1):
        depth = shared(paths[sorted_sets[i - 1]], paths[sorted_sets[i]]) if i < k else 0
        child: list | int = leaf
        while open_nodes[-1][0] > depth:
            node = open_nodes.pop()
            node[3].append(child)
            node[2] = i - 1
            child = node
        if open_nodes[-1][0] < depth:
            open_nodes.append([depth, child if isinstance(child, int) else child[1], i, [child]])
        else:
            open_nodes[-1][3].append(child)
        leaf = i

    own = np.array(sorted_sets)

    def more(overlap: np.ndarray, edge: np.ndarray) -> np.ndarray:
        lengths = post[edge + 1] - post[edge]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(post[edge] - (ends - lengths), lengths)
        return overlap + np.bincount(postings[at], minlength=k)

    waiting: list = [(child, 0, np.zeros(k, np.int64), np.ones(k, bool)) for child in root[3]]
    while waiting:
        node, depth, overlap, active = waiting.pop()
        a, b, down = (node, node, None) if isinstance(node, int) else (node[1], node[2], node[0])
        inside = own[a : b + 1]
        path = paths[inside[0]]
        down = len(path) if down is None else down
        # what is left out: sets in the component of the whole subtree, and those too short or too long for all of it
        low, high = size[inside].min(), size[inside].max()
        mine = labels[inside]
        active = active & (size * 100 >= low * percent) & (high * 100 >= size * percent)
        if (mine == mine[0]).all():
            active &= labels != mine[0]
        if not active.any():
            continue
        if down > depth:
            overlap = more(overlap, path[depth:down])
        if down:
            rest = row[1:] - np.searchsorted(keys, np.arange(k) * (len(frequent) + 1) + path[down - 1], "right")
            most = max(len(paths[i]) for i in inside) - down
            active &= (100 + percent) * (overlap + np.minimum(rest, most)) >= percent * (size + low)
        if isinstance(node, int):
            x = inside[0]
            linked = active & ((100 + percent) * overlap >= percent * (size + size[x]))
            if linked.any():
                groups = np.unique(np.append(labels[linked], labels[x]))
                labels[np.isin(labels, groups)] = groups[0]
        elif active.any():
            waiting += [(child, down, overlap, active) for child in node[3]]
    return labels


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (least doc_id reachable by links, its own included) of every row.

    Words are what stands between ASCII white space, A to Z in lower case; a set holds the distinct runs of ``size``
    words, of a shorter text the whole sequence. Two rows link when 100 * intersection >= ``percent`` * union. Null and
    empty texts have an empty set and no link. Rows that share a doc_id count as one document with several texts; rows without a doc_id
    link with nothing and get a null component. N-grams are compared by 64-bit hashes. Only (doc_id, text) are read.
    """
    sets = written(ngram_sets(docs, size, percent), "ngram-sets")
    slim = sets.select("doc_id", "n", "digest")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    total = usable.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_HASHES) + 1)
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * (100 - percent) * percent / 10000 - 1e-9))
    # a document counts as shared by as many of its hashes as needed; then equal sets become one class
    shared = shared_hashes(usable, buckets).groupBy("doc_id").agg(F.count("*").alias("common"), F.collect_list("token").alias("tokens"))
    alike = written(shared.join(slim.where("n > 0").dropDuplicates(["doc_id", "digest"]), "doc_id").where(F.col("common") >= least), "ngram-alike")
    classes = slim.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"))
    tokens = (
        alike.join(alike.groupBy("digest").agg(F.min("doc_id").alias("node")), "digest").where("doc_id = node")
        .select("node", "n", F.explode("tokens").alias("token"))
    )
    tokens = written(tokens.distinct(), "ngram-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("pivot")).where("df > 1")
    ranked = (
        tokens.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "pivot"))).alias("t"))
        .where(F.size("t") >= least)
        .select("node", F.explode(F.slice("t", F.lit(1), (F.size("t") - least + 1).cast("int"))).alias("t"))
        .select("node", F.col("t.pivot").alias("pivot"))
        .distinct()
    )
    grouped = written(components(ranked.select(F.col("node").alias("u"), F.col("pivot").alias("v")), "ngram-candidates"), "ngram-groups")
    links = written(_group_links(docs, grouped, size, percent), "ngram-links")
    members = slim.join(classes, "digest").select("doc_id", "node")
    same = members.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = components(links.union(same), "ngram-components").withColumnRenamed("node", "doc_id")
    return slim.join(roots, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _group_links(docs: DataFrame, grouped: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) ties between the members of each candidate group that are in one component, from tries over their whole sets."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, starts = shingles(Words(batch.column("text")), size)
            own = [np.unique(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("node"), pa.array([len(o) for o in own], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary())], ["grp", "node", "n", "hashes"])

    def ties(group: pa.Table) -> pa.Table:
        names = group.column("node").to_numpy()
        found = trie_components(names, [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()], percent)
        some = found != names
        return pa.table({"u": pa.array(names[some], pa.int64()), "v": pa.array(found[some], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    groups = grouped.select("node", F.col("root").alias("grp"))
    # the groups grow with the table, so they are never broadcast: the same plan at every size
    sets = written(texts.join(groups.hint("merge"), "node").select("grp", "node", "text").mapInArrow(full, "grp long, node long, n long, hashes binary").where("n > 0"), "ngram-full")
    # classes of length: only neighbours can link; a class is dealt into as many blocks as its hashes need
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * math.log(100 / percent)))
    sets = sets.withColumn("len", length)
    total = sets.groupBy("grp", "len").agg(F.sum("n").alias("hashes"))
    whole = total.groupBy("grp").agg(F.sum("hashes").alias("all"))
    plan = total.join(whole, "grp").select("grp", "len", (F.col("all") <= BLOCK_HASHES).alias("small"), F.ceil(F.col("hashes") / BLOCK_HASHES).cast("int").alias("blocks"))
    near = plan.alias("p").join(plan.alias("q"), (F.col("p.grp") == F.col("q.grp")) & (F.col("q.len").between(F.col("p.len") - 1, F.col("p.len") + 1))).groupBy("p.grp", "p.len", "p.small", "p.blocks").agg(F.collect_list(F.struct(F.col("q.len").alias("len"), F.col("q.blocks").alias("blocks"))).alias("others"))
    placed = sets.join(near, ["grp", "len"])
    block, other = F.struct("len", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b")), F.struct(F.col("o.len").alias("len"), F.col("i").cast("long").alias("b"))
    dealt = placed.where("NOT small").withColumn("o", F.explode("others")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1)))
    dealt = dealt.select("grp", F.to_json(F.sort_array(F.array(block, other))).alias("pair"), "node", "hashes")
    return placed.where("small").select("grp", F.lit("").alias("pair"), "node", "hashes").union(dealt).groupBy("grp", "pair").applyInArrow(ties, "u long, v long")
