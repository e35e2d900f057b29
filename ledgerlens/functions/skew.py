"""Helpers that keep one hot key from landing in one task.

Ordered windows measure before they plan: rows per key are counted (the counts combine on the map side, so only one
row per key and task is shuffled), and only if a key is heavy does the plan take the longer form. At most
``HEAVY_KEYS`` keys, the largest ones, are treated as heavy, so whatever is built from them has a proven
bound and may be broadcast; every other key has fewer than ``HEAVY_ROWS`` rows or at most one part in
``HEAVY_KEYS`` of all rows, which an ordinary shuffle carries.

``join_unique``    join of a large side to a side that is unique per key.
``split_heavy``    cuts the ordered rows of a heavy key into consecutive chunks, for ordered windows.
``number_rows``    gap-free row numbers per key in a given order, also for hot keys and for exact copies.
``spread``         writes a row many times, in several tasks if the count is large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

HEAVY_KEYS = 1000
HEAVY_ROWS = 1_000_000
CHUNKS = 200
SAMPLE = 4000
BLOCK = 4096


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame | None:
    """The at most ``HEAVY_KEYS`` largest keys of ``counts`` with at least ``HEAVY_ROWS`` rows, with their
    row count ``n``, as a local table; None if there are none."""
    top = counts.filter(F.col(n) >= HEAVY_ROWS).select(*keys, F.col(n).alias("n"))
    rows = top.orderBy(F.desc("n")).limit(HEAVY_KEYS).collect()
    return counts.sparkSession.createDataFrame(rows, top.schema) if rows else None


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key. ``how``: left, inner, left_semi, left_anti.

    An ordinary join: as only the left side can be skewed, adaptive execution may cut its large partitions for each of these
    kinds, also one of NULL keys, and reads the small right partition for each piece. Nothing is counted beforehand
    (``counts`` is accepted and not needed).
    """
    return left.join(right, list(keys), how)


def split_heavy(df: DataFrame, keys: Sequence[str], order: Sequence[str], counts: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0 for ordinary keys; for heavy keys the index of the range of ``order`` the row is in.

    Range limits come from a hash sample of the distinct order tuples, so equal tuples share a chunk and the
    result repeats exactly. At most ``CHUNKS`` limits per heavy key: safe to broadcast. The second result
    tells whether anything was split. Without keys the whole table is one group. ``counts``: rows ``n`` per key, at least those
    of ``df``, if they come cheaper than by counting ``df``; they decide only what is cut.
    """
    keys = list(keys)
    zero = F.lit(0)
    if keys:
        heavy = heavy_keys(df.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts, keys)
        if heavy is None:
            return df.withColumn("_chunk", zero), False
        every = heavy.select(*keys, F.ceil(F.col("n") / SAMPLE).alias("_every"))
        sampled = df.join(F.broadcast(every), keys, "inner")
    else:
        n = df.count()
        if n < min(HEAVY_ROWS, SAMPLE * 25):
            return df.withColumn("_chunk", zero), False
        sampled = df.withColumn("_every", F.lit(-(-n // SAMPLE)))
    place = F.struct(*order)
    points = (
        sampled.filter(F.pmod(F.xxhash64(*order), F.col("_every")) == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set(place)).alias("_points"))
    )
    limits = points.select(
        *keys,
        F.expr(
            f"transform(filter(sequence(0, {CHUNKS - 1}), k -> size(_points) > 0), "
            f"k -> element_at(_points, 1 + cast(floor(k * size(_points) / {CHUNKS}) as int)))"
        ).alias("_limits"),
    )
    if keys:
        limited = df.join(F.broadcast(limits), keys, "left")
    else:
        limited = df.withColumn("_limits", limits.select("_limits").scalar())
    passed = F.size(F.filter("_limits", lambda p: p <= place))
    return limited.withColumn("_chunk", F.when(F.col("_limits").isNull(), zero).otherwise(passed)).drop("_limits"), True


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row") -> DataFrame:
    """One row per input row with its 1-based number per key in ``order``; keeps keys and order columns only.

    One sort of the whole table by keys and order, cut into ranges by Spark, so that neither a hot key nor a table without keys
    lands in one task. The written ranges are counted, and a row's number is its place in its range and the rows of the ranges before.
    Exact copies get consecutive numbers; only copies of one row share a range.
    """
    keys, order = list(keys), list(order)
    ranges = cut(df.select(*keys, *order).orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    # the id is the number of the range and, in the lower 33 bits, the place in it
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ranges.join(F.broadcast(before), "_range").select(*keys, *order, place.alias(name))
    if not keys:
        return placed
    # written, so that a small table of keys is known to be small
    first = cut(placed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(name).alias("_first")))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return placed.join(first, same).select(*keys, *order, (F.col(name) - F.col("_first") + 1).alias(name))


def spread(df: DataFrame, start: str, count: str, name: str, most: int) -> DataFrame:
    """Write every row ``count`` times, numbered ``start, start+1, ...`` in column ``name``.

    ``most`` is the largest count. Rows with more than ``BLOCK`` copies are cut into blocks that different
    tasks write out.
    """
    each = F.explode(F.expr(f"sequence({start}, {start} + {count} - 1)"))
    if most <= BLOCK:
        return df.withColumn(name, each)
    few = df.filter(F.col(count) <= BLOCK).withColumn(name, each)
    many = (
        df.filter(F.col(count) > BLOCK)
        .withColumn("_from", F.explode(F.expr(f"sequence({start}, {start} + {count} - 1, {BLOCK})")))
        .repartition("_from")
        .withColumn(
            name,
            F.explode(F.expr(f"sequence(_from, least(_from + {BLOCK - 1}, {start} + {count} - 1))")),
        )
        .drop("_from")
    )
    return few.unionByName(many)
