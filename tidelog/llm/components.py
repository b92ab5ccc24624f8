"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .common import remove, saved, scratch

#: Each hot vertex's edges are dealt to this many join keys.
SALT = 8


def _minimum(edges: DataFrame) -> DataFrame:
    """Every (u, v) with the least vertex m of u and its neighbours.

    A vertex of very many edges is pre-aggregated per task, and its edges are
    joined to the minimum under salted keys.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALT))).join(spread, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _minimum(down)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(starred.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every vertex of ``edges`` (u, v); root is the least vertex.

    Each round is written to the shared folder, which cuts the lineage; it ends
    when a round changes no edge.  An empty table gives an empty result.
    """
    spark = edges.sparkSession
    path = scratch(spark, "stars")
    schema = edges.select("u", "v").schema

    def written(df: DataFrame, k: int) -> tuple[DataFrame, dict]:
        """The edges, written and read again, with their number and a checksum."""
        seen = Observation()
        df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).write.parquet(f"{path}/{k}")
        return spark.read.schema(schema).parquet(f"{path}/{k}"), seen.get

    now, seen = written(edges.select("u", "v").filter("u != v").distinct(), 0)
    for k in range(1, rounds + 1):
        if not seen["n"]:
            break
        before = seen
        now, seen = written(_small_star(_large_star(now)), k)
        remove(spark, f"{path}/{k - 1}")
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct())


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The result of :func:`components` for further ``edges`` besides those of ``roots``.

    Only edges between different roots count, so the stars are of what is new.
    """
    if edges.limit(1).count() == 0:
        return roots
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    mapped = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    joined = components(mapped.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    return saved(moved.unionAll(joined.join(roots, "node", "left_anti")), "roots")
