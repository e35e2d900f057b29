"""Exact nearest vectors by cosine, over cells that bounds leave out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

#: Centroids: the vectors of the least id hashes, a bounded sample. They decide how much is left out, never the result.
CELLS = 64
#: Vectors and queries of a cell that one task multiplies.
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 4_000
#: Similarities are ordered by nine decimals; bounds leave that much room.
_ROOM = 2e-9


def _unit(embeddings: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and which those are: vectors that are there and neither zero nor broken."""
    usable = embeddings.notna().to_numpy()
    if not usable.any():
        return np.empty((0, 0)), usable
    v = np.stack(embeddings[usable].to_numpy()).astype(float)
    norms = np.sqrt((v * v).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 0)
    at = np.flatnonzero(usable)[~fine]
    usable[at] = False
    return v[fine] / norms[fine, None], usable


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def vector_cells(vectors: DataFrame, cells: int = CELLS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, embedding, cell, angle) of every usable vector, and the centroids; a vector belongs to its nearest centroid."""
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(cells).toPandas()
    centroids, _ = _unit(some["embedding"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units, usable = _unit(pdf["embedding"])
            if len(units) and len(centroids):
                angles = _angles(units, centroids)
                cell = angles.argmin(axis=1)
                yield pdf[usable].assign(cell=cell.astype("int32"), angle=angles[np.arange(len(units)), cell])

    rows = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInPandas(assign, f"doc_id {kind}, embedding array<double>, cell int, angle double")), centroids


def _search(cells: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """Best ``top_k`` of each asked (query_id, embedding, cell), per block of a cell; large cells and many queries go to several tasks."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    plan = sizes.join(wanted, "cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = cells.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("part", spread(F.col("query_blocks")))
    right = asked.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int")).withColumn("block", spread(F.col("blocks")))
    id_kind, query_kind = cells.schema["doc_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def units_of(table: pa.Table) -> np.ndarray:
        v = np.array(table.column("embedding").to_pylist(), float)
        return v / np.sqrt((v * v).sum(axis=1))[:, None]

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names: list = []
        places: list[np.ndarray] = []
        values: list[np.ndarray] = []
        if vectors.num_rows and queries.num_rows:
            units, doc = units_of(vectors), vectors.column("doc_id").to_numpy()
            asked = queries.column("query_id").to_pylist()
            for at in range(0, len(asked), 256):
                similarity = units_of(queries.slice(at, 256)) @ units.T
                for row, query_id in zip(similarity, asked[at : at + 256], strict=True):
                    rounded = -np.round(row, 9)
                    if len(row) > top_k:  # those up to the k-th, ties included
                        near = np.flatnonzero(rounded <= np.partition(rounded, top_k - 1)[top_k - 1])
                    else:
                        near = np.arange(len(row))
                    order = near[np.lexsort((doc[near], rounded[near]))][:top_k]
                    names += [query_id] * len(order)
                    places.append(order)
                    values.append(row[order])
        found = pa.array(np.concatenate(places) if places else [], pa.int64())
        return pa.table(
            {
                "query_id": pa.array(names, queries.schema.field("query_id").type),
                "doc_id": vectors.column("doc_id").take(found),
                "similarity": pa.array(np.concatenate(values) if values else [], pa.float64()),
            }
        )

    keys = ["cell", "block", "part"]
    sides = [cut(df) for df in (left.select(*keys, "doc_id", "embedding"), right.select(*keys, "query_id", "embedding"))]
    found = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(best, f"query_id {query_kind}, doc_id {id_kind}, similarity double")
    return cut(found)


def embedding_search(vectors: DataFrame, queries: DataFrame, top_k: int = 5, cells: int = CELLS, report: dict | None = None) -> DataFrame:
    """Exact cosine top-k of ``vectors`` (doc_id, embedding) for each query (query_id, embedding): query_id, doc_id, similarity, rank.

    Vectors lie in cells around centroids. A query first searches the nearest cells that hold ``top_k`` vectors; its k-th
    similarity then rules out every cell whose whole radius is too far by the triangle inequality of angles. Queries stay a
    table, of any size. Null, zero and broken vectors and queries find nothing. Equal similarities go by doc_id; query ids must be unique.
    ``report`` gets the number of (query, cell) pairs and of those searched.
    """
    placed, centroids = vector_cells(vectors, cells)
    # one row for each cell: at most ``cells``
    stats = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    used = sorted(stats)
    sizes = np.array([stats[c][0] for c in used], np.int64)
    radius = np.array([stats[c][1] for c in used])
    middle = centroids[used] if used else centroids
    query_kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def pick(second: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                units, usable = _unit(pdf["embedding"])
                if not len(units) or not used:
                    continue
                some = pdf[usable]
                angles = _angles(units, middle)
                order = angles.argsort(axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                near = np.zeros(angles.shape, bool)
                np.put_along_axis(near, order, held < top_k, axis=1)
                if second:
                    reach = np.cos(np.maximum(angles - radius - 1e-7, 0.0))
                    near = ~near & (reach >= some["bound"].to_numpy()[:, None] - _ROOM)
                at, cell = np.nonzero(near)
                yield some.iloc[at][["query_id", "embedding"]].assign(cell=np.array(used, "int32")[cell])

        return run

    schema = f"query_id {query_kind}, embedding array<double>, cell int"
    first = cut(asked.mapInPandas(pick(False), schema))
    found = [_search(placed, first, top_k)]
    kth = found[0].groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s"))
    bound = kth.select("query_id", F.when(F.size("s") >= top_k, F.element_at("s", top_k)).otherwise(F.lit(-2.0)).alias("bound"))
    more = cut(asked.join(bound, "query_id").mapInPandas(pick(True), schema))
    if not more.isEmpty():
        found.append(_search(placed, more, top_k))
    if report is not None:
        report.update(pairs=bound.count() * len(used), searched=first.count() + more.count())
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "doc_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_k)
