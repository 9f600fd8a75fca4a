"""Exact vector search: a stated set of queries against all rows, in tiles that are multiplied as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.lexical import top_k

TILE_ROWS = 2048
METRICS = ("cosine", "dot", "euclid")


def _tiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                data = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4")
                ids = pa.array([part.column("id").to_pylist()], pa.list_(part.column("id").type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data.reshape(-1, width).tobytes()], pa.binary())], names=["ids", "data"])

    return run


def tiles(vectors: DataFrame, item: str, vector: str, width: int) -> DataFrame:
    """Rows of up to TILE_ROWS ids and one packed matrix; rows of another width or with null ids are left out."""
    kind = vectors.schema[item].dataType
    narrow = vectors.select(F.col(item).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(f"id is not null and size(v) = {width} and forall(v, x -> x is not null)")
    return narrow.mapInArrow(_tiles(width), T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())]))


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of a with all rows of b; a vector of length 0 has cosine 0 with all."""
    if metric == "euclid":
        return -((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :])
    raw = a @ b.T
    if metric == "dot":
        return raw
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    return raw * np.divide(1, na, out=np.zeros_like(na), where=na > 0)[:, None] * np.divide(1, nb, out=np.zeros_like(nb), where=nb > 0)[None, :]


def _score_task(width: int, metric: str, k: int, digits: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, d = batch.column("qids")[row].values, batch.column("ids")[row].values
                a = np.frombuffer(batch.column("qdata")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                b = np.frombuffer(batch.column("data")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                s = np.round(scores(a, b, metric), digits) + 0.0
                if distinct:
                    qi, di = q.to_pylist(), d.to_pylist()
                    where = {x: n for n, x in enumerate(di)}
                    for n, x in enumerate(qi):
                        if x in where:
                            s[n, where[x]] = -np.inf
                order = np.array(d.to_pylist()).astype(str).argsort(kind="stable") if pa.types.is_string(d.type) else np.argsort(d.to_numpy(zero_copy_only=False), kind="stable")
                s = s[:, order]
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(a)), best.shape[1])
                value = s[i, best.ravel()]
                keep = value > -np.inf
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i[keep])), d.take(pa.array(order[best.ravel()][keep])), pa.array(value[keep])], names=["query", "item", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, item: str, vector: str, width: int, metric: str = "cosine", k: int = 10, digits: int = 6, distinct: bool = True) -> DataFrame:
    """(query, item, score, rank): the k best rows of each query by exact score, rounded, then by item.

    Scores of either sign count. ``distinct`` leaves a query's own id out. Tiles of the queries meet tiles of the
    rows, each pair being one matrix product that keeps k rows per query; the pairs are as many as the work asks.
    """
    q = tiles(queries, item, vector, width).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    kind = vectors.schema[item].dataType
    pairs = tiles(vectors, item, vector, width).crossJoin(q)
    out = T.StructType([T.StructField("query", kind), T.StructField("item", kind), T.StructField("score", T.DoubleType())])
    return top_k(pairs.mapInArrow(_score_task(width, metric, k, digits, distinct), out), "query", "item", "score", k)


def _moment_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a = np.frombuffer(batch.column("qdata")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                b = np.frombuffer(batch.column("data")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                number = {x: n for n, x in enumerate(dict.fromkeys(batch.column("ids")[row].as_py()))}
                own = np.array([number[x] for x in batch.column("ids")[row].as_py()])
                asked = np.array([number.get(x, -1) for x in batch.column("qids")[row].as_py()])
                signs = np.where(b > 0, 1.0, -1.0)
                sums = np.zeros(6)
                for at in range(0, len(a), 256):
                    part = a[at : at + 256]
                    x = scores(part, b, "cosine")
                    y = np.where(part > 0, 1.0, -1.0) @ signs.T / 2  # half the width less the distance: a constant shift
                    use = (asked[at : at + 256, None] != own[None, :]) & np.isfinite(x)
                    x, y = x[use], y[use]
                    sums += [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], names=["n", "x", "y", "xx", "yy", "xy"])

    return run


def cosine_hamming_pearson(vectors: DataFrame, queries: DataFrame, item: str, vector: str, width: int) -> DataFrame:
    """One row, pearson: the correlation of cosine and negated Hamming distance of the signs over every pair of a
    query and another row; null where either doesn't vary. Each pair of tiles adds up its own sums."""
    q = tiles(queries, item, vector, width).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    sums = tiles(vectors, item, vector, width).crossJoin(q).mapInArrow(_moment_task(width), "n double, x double, y double, xx double, yy double, xy double")
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns])
    vx, vy = (F.col("n") * F.col(f"{c}{c}") - F.col(c) * F.col(c) for c in "xy")
    return total.select(F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.sqrt(vx) * F.sqrt(vy))).alias("pearson"))
