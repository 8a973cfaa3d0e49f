"""Graph operators: components, versions, paths and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from lamina.session import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with the least node of each connected component; edges (a, b).

    Alternating large-star and small-star steps: each keeps the edges' number and halves
    distances, so a chain of n nodes takes about log n rounds. Every round's table is a
    reliable checkpoint, so that a lost executor costs one round; what tells whether the round
    changed anything is observed while it is written. Where ``rounds`` don't suffice an error
    is raised. Null ends are left out.
    """
    both = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a is not null and b is not null")
    every = both.select(F.col("a").alias("node")).unionAll(both.select("b")).distinct()
    e = cut(both.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours point to its least neighbour, itself included.
        sym = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node's smaller neighbours and itself point to the least of them.
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(m, "u").select(F.col("v").alias("x"), "m").unionAll(m.select(F.col("u").alias("x"), "m")).filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        told = Observation()
        e = cut(small.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        now = told.get
        if now == seen:
            return every.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = now
    raise RuntimeError(f"components not found in {rounds} rounds")


def dedup_by_year(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first edge of each key and year (columns ``keys`` and year)."""
    w = W.partitionBy(*keys, "year").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def version_chain(versions: DataFrame, entity: str, order: list[Column]) -> DataFrame:
    """Newest first, each version linked from the newer one; the newest from the entity's head."""
    w = W.partitionBy(entity).orderBy(*order)
    return versions.withColumn("place", F.row_number().over(w)).withColumn("newer", F.coalesce(F.lag("version").over(w), F.concat(F.lit("n"), F.col(entity).cast("string"))))


def valid_at(valid_from: Column, valid_to: Column, recorded_at: Column, at: Column, known: Column) -> Column:
    """Valid at ``at`` as known at ``known``; an open end is null."""
    return (valid_from <= at) & (valid_to.isNull() | (at < valid_to)) & (recorded_at <= known)


def unsupported_claims(claims: DataFrame, verified: DataFrame, contradicted: DataFrame, keys: list[str]) -> DataFrame:
    """Claims that nothing verifies and something contradicts."""
    return claims.join(verified, keys, "left_anti").join(contradicted, keys, "left_semi")
