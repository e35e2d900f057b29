"""Vendor entities and name similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_unique
from ..functions.text import contains_pairs, levenshtein_ratio, sequence_ratio


def resolve_entities(vendors: DataFrame, kg: DataFrame) -> DataFrame:
    """Each distinct vendor name with its entity: the name is the canonical name or an alias, or part of an
    alias. Ties go to the smallest entity id; names without a hit become ``unknown_<lower_snake>``."""
    names = vendors.filter("vendor is not null").select("vendor").distinct()
    aliases = kg.select("entity_id", F.explode("aliases").alias("text"))
    known = kg.select("entity_id", F.col("canonical_name").alias("text")).unionByName(aliases)
    equal = names.join(known.withColumnRenamed("text", "vendor"), "vendor").select("vendor", "entity_id")
    spelled = aliases.groupBy("text").agg(F.min("entity_id").alias("entity_id"))
    inside = contains_pairs(
        spelled.withColumnRenamed("entity_id", "e").select(F.col("text").alias("text_id"), "text"),
        names.select(F.col("vendor").alias("needle")),
    )
    within = inside.join(spelled, inside.text_id == spelled.text).select(
        F.col("needle").alias("vendor"), "entity_id"
    )
    best = equal.unionByName(within).groupBy("vendor").agg(F.min("entity_id").alias("entity_id"))
    hits = best.join(kg, "entity_id").select("vendor", "entity_id", "canonical_name", "aliases")
    unknown = F.concat(F.lit("unknown_"), F.lower(F.replace(F.col("vendor"), F.lit(" "), F.lit("_"))))
    return names.join(hits, "vendor", "left").select(
        F.col("vendor").alias("vendor_name"),
        F.coalesce("entity_id", unknown).alias("canonical_entity_id"),
        F.when(F.col("entity_id").isNull(), F.col("vendor")).otherwise(F.col("canonical_name")).alias("canonical_name"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("entity_id").isNull(), F.lit(0.0)).otherwise(F.lit(0.95)).alias("confidence"),
    )


def entities_of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type)


def vendor_similarity(pairs: DataFrame, a: str = "vendor_a", b: str = "vendor_b") -> DataFrame:
    """Adds ``similarity`` (Ratcliff/Obershelp). The Python code sees every distinct pair once."""
    distinct = pairs.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    scored = distinct.withColumn("similarity", sequence_ratio(F.col(a), F.col(b)))
    return join_unique(pairs, scored, [a, b]).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def vendor_similarity_lev(pairs: DataFrame, a: str = "vendor_a", b: str = "vendor_b") -> DataFrame:
    """Adds ``similarity`` from the Levenshtein distance, inside the JVM."""
    return pairs.withColumn("similarity", levenshtein_ratio(F.col(a), F.col(b)))


def fuzzy_vendor_pairs_sequence(s1: DataFrame, s2: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Distinct vendor names of two sources whose Ratcliff/Obershelp similarity reaches ``threshold``.

    Blocking loses nothing: a ratio of at least t over lengths la, lb means that the names share a common
    subsequence of t(la+lb)/2 characters, so at most k = (1-t)(la+lb) characters are deleted or inserted. Cut
    the first name into k+1 pieces and one of them is untouched, so it is a substring of the second name
    starting at most k places away. Pieces and substrings meet in an equi join.
    """
    slack = (1 - threshold) * (1 + (2 - threshold) / threshold)  # k per character of the first name

    def names(df: DataFrame) -> DataFrame:
        return df.filter("vendor is not null").select(
            "vendor", F.lower(F.trim("vendor")).alias("s")
        ).distinct().filter(F.length("s") > 0)

    n = F.length("s")
    pieces = (
        names(s1)
        .withColumn("k", F.floor(n * F.lit(slack) + F.lit(1e-9)).cast("int"))
        .withColumn("m", F.least(F.col("k") + 1, n))
        .withColumn("q", F.explode(F.expr("sequence(0, m - 1)")))
        .withColumn("start", F.expr("cast(floor(q * length(s) / m) as int)"))
        .withColumn("size", F.expr("cast(floor((q + 1) * length(s) / m) as int)") - F.col("start"))
        .select(
            F.col("vendor").alias("vendor_a"),
            F.col("s").alias("a"),
            "k",
            "start",
            F.expr("substr(s, start + 1, size)").alias("piece"),
        )
    )
    sizes = pieces.agg(F.array_sort(F.collect_set(F.length("piece"))).alias("z")).scalar()
    parts = (
        names(s2)
        .withColumn("z", F.explode(F.when(n > 0, sizes)))
        .filter(F.col("z") <= n)
        .withColumn("at", F.explode(F.expr("sequence(0, length(s) - z)")))
        .select(
            F.col("vendor").alias("vendor_b"), F.col("s").alias("b"), "at", F.expr("substr(s, at + 1, z)").alias("piece")
        )
    )
    la, lb = F.length("a"), F.length("b")
    fits = (2 * F.least(la, lb) >= threshold * (la + lb) - 1e-9) & (F.abs(F.col("at") - F.col("start")) <= F.col("k"))
    pairs = pieces.join(parts, "piece").filter(fits).select("vendor_a", "vendor_b").distinct()
    scored = pairs.withColumn("similarity", sequence_ratio(F.col("vendor_a"), F.col("vendor_b")))
    return scored.filter(F.col("similarity") >= threshold)


def fuzzy_vendor_pairs(s1: DataFrame, s2: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Distinct vendor names of two sources whose Levenshtein similarity (lower case, trimmed, three decimals) reaches ``threshold``.

    Names of the first source are cut into one segment more than edits are allowed at their length, so that one segment survives in
    every name that is near enough. The index key is (length, segment number, segment). A name of the second source looks up, for
    every length it may pair with, only substrings at the places where that segment can stand after the edits before it and those
    left behind it. Short segments only meet names of their own length and number, so no key joins everything. Then the
    JVM compares the pairs that are left. Missing and empty names pair with nothing. Thresholds start at 0.55: below, short names
    may lose all their segments.
    """
    if threshold < 0.55:
        raise ValueError("the threshold must be at least 0.55")
    least = threshold - 0.0005  # similarities are rounded before they are compared

    def names(df: DataFrame, vendor: str, s: str) -> DataFrame:
        return df.filter("vendor is not null").select(F.col("vendor").alias(vendor), F.lower(F.trim("vendor")).alias(s)).distinct().filter(F.length(s) > 0)

    def most_edits(longer):
        return F.floor(longer * F.lit(1 - least) + F.lit(1e-9)).cast("int")

    def place(i, n, parts):
        """Start of segment ``i`` of ``parts`` in a name of length ``n``."""
        return F.floor(i * n / parts).cast("int")

    la, lb = F.col("la"), F.col("lb")
    # the longest partner of a name of length la has floor(la / least) letters
    edits = most_edits(F.floor(la / F.lit(least) + F.lit(1e-9)))
    parts = F.least(edits + 1, la)
    start, end = place(F.col("i"), la, parts), place(F.col("i") + 1, la, parts)
    index = (
        names(s1, "vendor_a", "a")
        .withColumn("la", F.length("a"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("vendor_a", "a", "la", "i", F.substr(F.col("a"), start + 1, end - start).alias("segment"))
    )
    shift = lb - la
    lowest = F.greatest(start - F.col("i"), start + shift - (edits - F.col("i")), F.lit(0))
    highest = F.least(start + F.col("i"), start + shift + (edits - F.col("i")), lb - (end - start))
    # segments beyond the letters of a very short name do not exist
    probes = (
        names(s2, "vendor_b", "b")
        .withColumn("lb", F.length("b"))
        .withColumn("la", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(lb * F.lit(least) - F.lit(1e-9)).cast("int")), F.floor(lb / F.lit(least) + F.lit(1e-9)).cast("int"))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"lowest": lowest, "highest": highest, "size": end - start})
        .filter("lowest <= highest")
        .withColumn("at", F.explode(F.sequence("lowest", "highest")))
        .select("vendor_b", "b", "la", "i", F.substr(F.col("b"), F.col("at") + 1, F.col("size")).alias("segment"))
    )
    pairs = index.join(probes, ["la", "i", "segment"]).select("vendor_a", "a", "vendor_b", "b").distinct()
    scored = pairs.withColumn("similarity", levenshtein_ratio(F.col("a"), F.col("b")))
    return scored.filter(F.col("similarity") >= threshold).select("vendor_a", "vendor_b", "similarity")
