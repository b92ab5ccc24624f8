"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, several times over, each time by
another orthonormal projection and with another shift, and each projection is
ordered along a Hilbert curve.  Spark range-partitions the keys of every curve,
which gives every vector a rank on it.  A query takes as candidates the vectors
in a window of ranks around its own key; the windows of all curves are reranked
by the exact inner product and merged.

Inner products are turned to angles first: every vector gets one more
coordinate that makes all lengths equal, and a query has none of it.

The width of the windows, as a share of all vectors, is the least of ``SHARES``
that reaches ``TARGET`` recall on a sample of ``SAMPLE`` rows, on which the
projections are scaled too.  For vectors without structure it is a large
share, as it must be; for clustered ones a small one.  All rows are indexed.

Defined results
    null, zero, null or non-finite components   the row takes no part
    other dimension than most rows              the row takes no part
    null ids                                    the row takes no part
    fewer candidates than asked for             all of them
    ties                                        to the smaller vec_id
    repeated ids                                one candidate, by its best row
    empty table                                 an empty result
    further columns                             ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved
from .hilbert import positions

CURVES = 6
DIMENSIONS, BITS = 4, 12
SAMPLE = 8192
TARGET = 0.96
SHARES = (0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0)
#: Vectors in one block of ranks, and queries that meet it in one task, about.
BLOCK = 8192
QUERIES = 4096
SEED = 3


@dataclass(frozen=True)
class Curves:
    """The projections and shifts, and the window share."""

    projections: np.ndarray  # curve, coordinate, dimension
    spread: np.ndarray  # curve, dimension
    shifts: np.ndarray  # curve, dimension
    longest: float
    share: float = 1.0

    def items(self, vectors: np.ndarray) -> np.ndarray:
        """Keys of vectors as candidates: one column per curve."""
        rest = np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        return self._keys(np.concatenate([vectors, rest[:, None]], axis=1) / self.longest)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
        return self._keys(np.concatenate([unit, np.zeros((len(vectors), 1))], axis=1))

    def _keys(self, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), len(self.projections)), np.int64)
        for k, (projection, spread, shift) in enumerate(zip(self.projections, self.spread, self.shifts)):
            flat = np.tanh(points @ projection / spread) / 4 + 0.25 + shift
            out[:, k] = positions(np.minimum(flat * (1 << BITS), (1 << BITS) - 1).astype(np.uint64), BITS)
        return out


def fit(sample: np.ndarray, longest: float, total: int, k: int) -> Curves:
    """Curves for vectors like ``sample``, drawn from ``total`` rows."""
    random = np.random.default_rng(SEED)
    dimension = sample.shape[1] + 1
    width = min(DIMENSIONS, dimension)
    projections = np.stack([np.linalg.qr(random.normal(size=(dimension, width)))[0] for _ in range(CURVES)])
    shifts = random.random((CURVES, width)) / 2
    curves = Curves(projections, np.ones((CURVES, width)), shifts, longest)
    rest = np.sqrt(np.maximum(0, longest**2 - (sample**2).sum(axis=1)))
    points = np.concatenate([sample, rest[:, None]], axis=1) / longest
    spread = np.stack([1.2 * (points @ p).std(axis=0) + 1e-9 for p in projections])
    curves = Curves(projections, spread, shifts, longest)
    # what share of ranks a query must see, by the nearest rows within the sample
    m = len(sample)
    asked = np.arange(0, m, max(1, m // 256))
    near = min(m - 1, max(1, round(k * m / max(total, 1))))
    if near < 1:
        return curves
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, :near]
    item_keys, query_keys = curves.items(sample), curves.queries(sample[asked])
    ranks = np.argsort(np.argsort(item_keys, axis=0, kind="stable"), axis=0)
    own = np.stack([np.searchsorted(np.sort(item_keys[:, c]), query_keys[:, c]) for c in range(CURVES)], axis=1)
    for share in SHARES:
        low, high = window(own, m, share)
        placed = ranks[nearest]  # query, neighbour, curve
        found = ((placed >= low[:, None, :]) & (placed < high[:, None, :])).any(axis=2)
        if found.mean() >= TARGET:
            break
    return Curves(projections, spread, shifts, longest, share)


def window(rank, total: int, share: float):
    """[low, high) of ranks: ``share`` of all around ``rank``, moved inside."""
    width = min(total, int(np.ceil(share * total)) + 1)
    low = np.clip(rank - width // 2, 0, total - width)
    return low, low + width


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows that take part, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                row = np.array(v, np.float64)
                if np.isfinite(row).all() and row.any():
                    ids.append(i)
                    out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])

    vectors = table.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "vec_id long, vector binary")
    vectors = saved(vectors, "vectors")
    sizes = vectors.groupBy(F.octet_length("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return vectors.filter(F.octet_length("vector") == (sizes["size"] if sizes else 0))


def _measure(vectors: DataFrame) -> tuple[int, float]:
    """How many vectors, and the longest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, longest = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                rows += batch.num_rows
                longest = max(longest, float(np.sqrt((_matrix(batch.column(0)) ** 2).sum(axis=1)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([longest])], ["rows", "longest"])

    row = vectors.select("vector").mapInArrow(run, "rows long, longest double").agg(F.sum("rows"), F.max("longest")).first()
    return row[0] or 0, row[1] or 0.0


def _ranked(vectors: DataFrame, curves: Curves, every: int) -> tuple[DataFrame, int]:
    """(curve, role, vec_id, rank): role 0 are all vectors, role 1 the queries.

    A rank counts the vectors before a row on its curve.  Equal keys are ordered
    by id, so a key of very many rows still falls into many blocks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            asking = ids % every == 0
            for role, who, places in ((0, ids, curves.items(rows)), (1, ids[asking], curves.queries(rows[asking]))):
                n = len(who)
                columns = [np.repeat(np.arange(CURVES, dtype=np.int32), n), places.T.reshape(-1), np.full(n * CURVES, role, np.int32), np.tile(who, CURVES)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["curve", "key", "role", "vec_id"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), dict.fromkeys(range(CURVES), 0)
        for batch in batches:
            curve, role = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at = np.zeros(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                own = curve == c
                counted = np.cumsum(role[own] == 0)
                at[own] = before[c] + counted - (role[own] == 0)
                before[c] += int(counted[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(at), part, np.int32)), pa.array(at)], ["curve", "role", "vec_id", "part", "place"])

    order = ["curve", "key", "role", "vec_id"]
    dealt = vectors.mapInArrow(keys, "curve int, key long, role int, vec_id long").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(dealt.mapInArrow(place, "curve int, role int, vec_id long, part int, place long"), "curve-ranks")
    # one row for each curve and partition
    parts = placed.groupBy("curve", "part").agg(F.sum((F.col("role") == 0).cast("long")).alias("n"))
    first = parts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.join(first.select("curve", "part", "first"), ["curve", "part"])
    return ranked.select("curve", "role", "vec_id", (F.col("first") + F.col("place")).alias("rank"))


def _scored(k: int):
    """Reranks one block of vectors for the queries that see it."""

    def run(items, queries):
        import pandas as pd

        names = ["query_id", "vec_id", "score"]
        if not len(items) or not len(queries):
            return pd.DataFrame({n: pd.Series(dtype="int64" if n != "score" else "float64") for n in names})
        items = items.sort_values("vec_id", kind="stable")
        ids = items["vec_id"].to_numpy()
        rows = np.frombuffer(b"".join(items["vector"]), np.float64).reshape(len(ids), -1)
        out = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            asked = part["query_id"].to_numpy()
            vectors = np.frombuffer(b"".join(part["asked"]), np.float64).reshape(len(asked), -1)
            rough = vectors @ rows.T
            rough[asked[:, None] == ids[None, :]] = -np.inf
            keep = min(k, len(ids))
            floor = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
            slack = 1e-9 * (1 + np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(axis=1))
            for q in range(len(asked)):
                near = np.flatnonzero((rough[q] >= floor[q] - slack[q]) & np.isfinite(rough[q]))
                # a sum along a row does not depend on where the row stands, so equal vectors tie
                score = (rows[near] * vectors[q]).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(best), asked[q]), ids[near][best], score[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    return run


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``.
    """
    spark = table.sparkSession
    vectors = clean_vectors(table, id_col, vector_col)
    total, longest = _measure(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if total < 2:
        return spark.createDataFrame([], schema)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()  # SAMPLE rows at most
    curves = fit(np.array([np.frombuffer(r[0], np.float64) for r in picked]), longest, total, k)

    ranked = saved(_ranked(vectors, curves, every), "ranks")
    counted = ranked.filter("role = 1 and curve = 0").count()
    width = min(total, int(np.ceil(curves.share * total)) + 1)
    chunks = max(1, -(-counted * (width + BLOCK) // (max(total, BLOCK) * QUERIES)))
    items = ranked.filter("role = 0").withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int"))
    items = items.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("curve", "block", "chunk", "vec_id")
    low: Column = F.greatest(F.lit(0), F.least(F.col("rank") - width // 2, F.lit(total - width)))
    seen = F.sequence(F.floor(low / BLOCK).cast("int"), F.floor((low + (width - 1)) / BLOCK).cast("int"))
    queries = ranked.filter("role = 1").withColumn("block", F.explode(seen))
    queries = queries.select("curve", "block", F.pmod(F.hash("vec_id"), F.lit(chunks)).alias("chunk"), "vec_id")
    group = ["curve", "block", "chunk"]
    asking = queries.join(vectors, "vec_id").select(*[F.col(c).alias(f"q_{c}") for c in group], F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    near = (
        items.join(vectors, "vec_id").select(*group, "vec_id", "vector").groupBy(*group)
        .cogroup(asking.groupBy(*[f"q_{c}" for c in group]))
        .applyInPandas(_scored(k), "query_id long, vec_id long, score double")
    )
    merged = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
