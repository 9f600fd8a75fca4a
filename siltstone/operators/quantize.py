"""Scalar, ternary and product quantization of vectors, with their scores and code statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.vector import pack


def components(vectors: DataFrame, item: str, vector: str) -> DataFrame:
    """(id, dim, x): a row per component."""
    return vectors.where(F.col(vector).isNotNull()).select(F.col(item).alias("id"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def equal_mass_thresholds(vectors: DataFrame, item: str, vector: str, levels: int) -> DataFrame:
    """(dim, thresholds): the levels - 1 cuts that give each code the same number of rows, by nearest rank."""
    cuts = [F.expr(f"percentile_disc({k / levels}) within group (order by x)") for k in range(1, levels)]
    return components(vectors, item, vector).groupBy("dim").agg(F.array(*cuts).alias("thresholds"))


def scalar_codes(vectors: DataFrame, item: str, vector: str, thresholds: DataFrame) -> DataFrame:
    """(id, dim, code): how many thresholds of its dimension a component exceeds."""
    joined = components(vectors, item, vector).join(F.broadcast(thresholds), "dim")
    return joined.select("id", "dim", F.size(F.filter("thresholds", lambda t: F.col("x") > t)).alias("code"), "x")


def code_centers(codes: DataFrame) -> DataFrame:
    """(dim, code, center, n): the mean of the components that have a code."""
    return codes.groupBy("dim", "code").agg(F.avg("x").alias("center"), F.count("*").alias("n"))


def code_entropy(codes: DataFrame) -> DataFrame:
    """(dim, entropy): in bits, of each dimension's codes."""
    from pyspark.sql import Window

    counted = codes.groupBy("dim", "code").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    return counted.withColumn("p", p).groupBy("dim").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def kmeans_thresholds(vectors: DataFrame, item: str, vector: str, rounds: int = 8) -> DataFrame:
    """(dim, centers, thresholds): three centers per dimension by Lloyd's rounds from the 1/6, 1/2 and 5/6 quantiles.

    Each round is one aggregate over all rows: a component goes to its nearest center, the lower one of two as near.
    """
    from siltstone.session import stored

    rows = stored(components(vectors, item, vector).select("dim", "x"))
    centers = rows.groupBy("dim").agg(F.percentile("x", F.array(F.lit(1 / 6), F.lit(0.5), F.lit(5 / 6))).alias("c"))
    for _ in range(rounds):
        near = rows.join(F.broadcast(centers), "dim").select("dim", "c", "x", F.array_position(F.transform("c", lambda c: F.abs(F.col("x") - c)), F.array_min(F.transform("c", lambda c: F.abs(F.col("x") - c)))).alias("own"))
        means = [F.avg(F.when(F.col("own") == k + 1, F.col("x"))).alias(f"m{k}") for k in range(3)]
        centers = near.groupBy("dim").agg(F.first("c").alias("c"), *means).select("dim", F.array(*[F.coalesce(f"m{k}", F.col("c")[k]) for k in range(3)]).alias("c"))
        centers = stored(centers)  # three numbers per dimension
    middle = F.array(*[(F.col("c")[k] + F.col("c")[k + 1]) / 2 for k in range(2)])
    return centers.select("dim", F.col("c").alias("centers"), middle.alias("thresholds"))


def packed_codes(codes: DataFrame, width: int, symbols: int, per_byte: int) -> DataFrame:
    """(id, packed): codes below ``symbols`` as digits of a byte, ``per_byte`` dimensions each, digit o of byte i being
    dimension i * per_byte + o."""
    if symbols**per_byte > 256:
        raise ValueError("so many symbols don't fit a byte")
    at = F.floor(F.col("dim") / per_byte)
    digit = F.col("code") * F.pow(F.lit(float(symbols)), F.col("dim") % per_byte)
    sums = codes.groupBy("id", at.cast("int").alias("at")).agg(F.sum(digit).cast("int").alias("v"))
    count = -(-width // per_byte)
    return sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("packed"))


def packed_scores(packed: DataFrame, centers: np.ndarray, queries: DataFrame, item: str, vector: str, symbols: int, per_byte: int, k: int = 10) -> DataFrame:
    """(query, item, score, rank): the k largest sums of query component times code center, by one table look-up per
    byte; ``centers`` is (dimension, symbol). The tables, (bytes x symbols ** per_byte) numbers a query, are made where
    the blocks of queries meet the blocks of codes."""
    from siltstone.operators.lexical import top_k
    from siltstone.operators.vectors import tiles

    kind, (width, _), count = queries.schema[item].dataType, centers.shape, -(-centers.shape[0] // per_byte)
    values = np.arange(symbols**per_byte)
    digits = np.stack([values // symbols**o % symbols for o in range(per_byte)], 1)
    asked = tiles(queries, item, vector, width).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    blocks = packed.withColumn("t", F.spark_partition_id() * F.lit(1 << 20) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / 8192)).groupBy("t").agg(F.collect_list(F.struct("id", "packed")).alias("r")).select(F.col("r.id").alias("ids"), F.col("r.packed").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q, d = b.column("qids")[row].values, b.column("ids")[row].values
                x = np.frombuffer(b.column("qdata")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                codes = b.column("codes")[row].values.flatten().to_numpy().reshape(-1, count)
                score = np.zeros((len(x), len(codes)))
                for i in range(count):
                    dims = np.arange(i * per_byte, min(width, (i + 1) * per_byte))
                    table = sum(x[:, [dim]] * centers[dim, digits[:, o]][None, :] for o, dim in enumerate(dims))
                    score += table[:, codes[:, i]]
                score = np.round(score, 6)
                order = np.argsort(d.to_numpy(zero_copy_only=False), kind="stable")
                best = np.argsort(-score[:, order], axis=1, kind="stable")[:, : k + 1]
                i = np.repeat(np.arange(len(x)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), d.take(pa.array(order[best.ravel()])), pa.array(score[i, order[best.ravel()]] + 0.0)], names=["query", "item", "score"])

    out = T.StructType([T.StructField("query", kind), T.StructField("item", kind), T.StructField("score", T.DoubleType())])
    return top_k(blocks.crossJoin(asked).mapInArrow(run, out).where("query <> item"), "query", "item", "score", k)


def ternary_codes(vectors: DataFrame, item: str, vector: str, width: int, threshold: float) -> DataFrame:
    """(id, nonzero, sign): two bit planes, set where a component's size exceeds the threshold and where it is positive."""
    v = F.col(vector)
    fine = vectors.where(F.size(v) == width)
    far = F.transform(v, lambda x: (F.abs(x) > threshold).cast("long"))
    up = F.transform(v, lambda x: (x > threshold).cast("long"))
    return fine.select(F.col(item).alias("id"), pack(far, width).alias("nonzero"), pack(up, width).alias("sign"))


def ternary_distance(a: str, b: str, words: int) -> F.Column:
    """Sum of |difference| of codes in -1, 0, 1, from the planes of two sides with these prefixes."""
    total = None
    for w in range(words):
        na, nb = F.col(f"{a}nonzero")[w], F.col(f"{b}nonzero")[w]
        sa, sb = F.col(f"{a}sign")[w], F.col(f"{b}sign")[w]
        part = F.bit_count(na.bitwiseXOR(nb)) + 2 * F.bit_count(na.bitwiseAND(nb).bitwiseAND(sa.bitwiseXOR(sb)))
        total = part if total is None else total + part
    return total


class ProductQuantizer:
    """Codebooks of 2 ** bits centers for equal parts of the vectors, optionally after a learned rotation."""

    def __init__(self, sample: np.ndarray, parts: int = 8, bits: int = 4, rounds: int = 15, rotate: int = 0, seed: int = 42):
        self.parts, self.size = parts, 1 << bits
        self.turn = np.eye(sample.shape[1])
        for _ in range(max(1, rotate + 1)):
            x = sample @ self.turn
            self.books = [self._means(x[:, p], rounds, seed) for p in self._slices(sample.shape[1])]
            if rotate:
                u, _, v = np.linalg.svd(sample.T @ self.decode(self.encode_raw(sample), raw=True))
                self.turn = u @ v

    @classmethod
    def from_books(cls, books: np.ndarray) -> ProductQuantizer:
        """A quantizer of given codebooks (part, center, component), without rotation."""
        own = cls.__new__(cls)
        own.parts, own.size, own.books = len(books), books.shape[1], [np.asarray(b, float) for b in books]
        own.turn = np.eye(books.shape[0] * books.shape[2])
        return own

    def _slices(self, width: int) -> list[slice]:
        step = width // self.parts
        return [slice(p * step, (p + 1) * step) for p in range(self.parts)]

    def _means(self, x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        centers = x[rng.choice(len(x), self.size, replace=len(x) < self.size)].copy()
        for _ in range(rounds):
            near = self._near(x, centers)
            for c in range(self.size):
                if (near == c).any():
                    centers[c] = x[near == c].mean(0)
        return centers

    @staticmethod
    def _near(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]).argmin(1)

    def encode_raw(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.turn
        return np.stack([self._near(y[:, p], book) for p, book in zip(self._slices(x.shape[1]), self.books)], 1)

    def decode(self, codes: np.ndarray, raw: bool = False) -> np.ndarray:
        y = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        return y if raw else y @ self.turn.T

    def encode(self, vectors: DataFrame, item: str, vector: str) -> DataFrame:
        """(id, codes)."""
        kind, width = vectors.schema[item].dataType, len(self.turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(self.encode_raw(x)), pa.list_(pa.int64()))], names=["id", "codes"])

        narrow = vectors.select(F.col(item).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(f"id is not null and size(v) = {width}")
        return narrow.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("codes", T.ArrayType(T.LongType()))]))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all centers: (query, part, center)."""
        y = queries @ self.turn
        return np.stack([((y[:, None, p] - book[None]) ** 2).sum(2) for p, book in zip(self._slices(queries.shape[1]), self.books)], 1)


def pq_top_k(codes: DataFrame, quantizer: ProductQuantizer, queries: DataFrame, item: str, vector: str, k: int = 10) -> DataFrame:
    """(query, item, score, rank): the k least sums of table entries, by task and then over all.

    The queries go to the tasks in blocks of packed tables that are joined with blocks of codes.
    """
    from siltstone.operators.vectors import tiles

    kind, width, parts, size = queries.schema[item].dataType, len(quantizer.turn), quantizer.parts, quantizer.size
    asked = tiles(queries, item, vector, width).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    stored = codes.withColumn("t", F.spark_partition_id() * F.lit(1 << 20) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / 8192)).groupBy("t").agg(F.collect_list(F.struct("id", "codes")).alias("r")).select(F.col("r.id").alias("ids"), F.col("r.codes").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q, d = b.column("qids")[row].values, b.column("ids")[row].values
                x = np.frombuffer(b.column("qdata")[row].as_py(), "<f4").reshape(-1, width).astype(float)
                c = b.column("codes")[row].values.flatten().to_numpy().reshape(-1, parts)
                table = quantizer.tables(x).reshape(len(x), parts * size)
                flat = c + np.arange(parts) * size
                s = np.round(sum(table[:, flat[:, p]] for p in range(parts)), 6)
                order = np.argsort(d.to_numpy(zero_copy_only=False), kind="stable")
                best = np.argsort(s[:, order], axis=1, kind="stable")[:, : k + 1]
                i = np.repeat(np.arange(len(x)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), d.take(pa.array(order[best.ravel()])), pa.array(s[i, order[best.ravel()]])], names=["query", "item", "score"])

    from pyspark.sql import Window

    out = T.StructType([T.StructField("query", kind), T.StructField("item", kind), T.StructField("score", T.DoubleType())])
    near = stored.crossJoin(asked).mapInArrow(run, out).where("query <> item")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "item"))).where(F.col("rank") <= k)
