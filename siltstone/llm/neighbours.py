"""Most similar vectors for every vector: windows along shifted Hilbert curves, merged and reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.topn import heap_task
from siltstone.session import parallelism, stored

#: Curves, dimensions and bits a dimension of each, and the neighbours on either side that are compared. Measured
#: against brute force, see the README; dimensions times bits must stay below 64.
CURVES, DIMENSIONS, BITS, WINDOW = 20, 12, 5, 160
#: Vectors on which the scale of the projections is fitted; all vectors are indexed.
FIT_ROWS = 20_000
TILE = 256
#: How far the cosine of vectors in bytes is off at most in practice (measured: 0.004), and how many more neighbours
#: than asked for are therefore compared exactly.
MARGIN, SPARE = 0.006, 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of unsigned coordinates) along the Hilbert curve, by Skilling's transform."""
    x = cells.astype(np.uint32).copy()
    n = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint32(bit - 1)
        for d in range(n):
            up = (x[:, d] & bit) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & low).astype(np.uint32)
            x[:, 0] ^= np.where(up, low, swap).astype(np.uint32)
            x[:, d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[:, n - 1] & bit) != 0, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


class CurveIndex:
    """Seeded orthogonal projections, shifts and the fitted scale: what turns vectors into keys, a few kilobytes.

    Each curve is cut into ``ranges`` parts at quantiles of the sample's keys.
    """

    def __init__(self, sample: np.ndarray, width: int, curves: int, ranges: int = 1, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dims = min(DIMENSIONS, width)
        self.bits = BITS
        self.ranges = ranges
        self.parts = []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims].astype(np.float32)
            y = sample @ axes if len(sample) else np.zeros((1, self.dims))
            self.parts.append((axes, y.mean(0), 2.5 * y.std(0) + 1e-9, rng.uniform(0, 0.25, self.dims)))
        self.cuts = [np.quantile(k, np.arange(1, ranges) / ranges, method="nearest") if len(sample) else np.zeros(0) for k in self.keys(sample)]

    def keys(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        for axes, middle, reach, shift in self.parts:
            z = np.clip(((unit @ axes - middle) / reach + 1) / 2 * 0.75 + shift, 0, 1 - 1e-6)
            yield hilbert_keys((z * (1 << self.bits)).astype(np.uint32), self.bits)

    def places(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each curve the keys, and the numbers of the parts that they fall into."""
        for c, key in enumerate(self.keys(unit)):
            yield key, c * self.ranges + np.searchsorted(self.cuts[c], key, side="right")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _key_task(index: CurveIndex, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.float32)
            # what travels along the curves: components as bytes, in parts of the largest
            sketch = np.rint(unit * (127 / np.abs(unit).max(1))[:, None]).astype(np.int8)
            packed = pa.Array.from_buffers(pa.binary(width), len(unit), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            for key, part in index.places(unit):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), batch.column("no"), packed], names=["part", "key", "no", "s"])

    return run


def _tile(part: np.ndarray, unit: np.ndarray, first: int, last: int, k: int, window: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row's window, for the rows from first to last: (row, other, approximate cosine)."""
    a, b = max(0, first - window), min(len(unit), last + window)
    near = unit[first:last] @ unit[a:b].T
    gap = np.arange(a, b)[None, :] - np.arange(first, last)[:, None]
    near[(gap == 0) | (np.abs(gap) > window) | (part[first:last, None] != part[None, a:b])] = -2
    hit = near > max(least - MARGIN, -1.5)
    many = hit.sum(1) > k
    if many.any():
        best = np.argpartition(-near[many], k - 1, axis=1)[:, :k]
        kept = np.zeros((int(many.sum()), near.shape[1]), bool)
        np.put_along_axis(kept, best, True, axis=1)
        hit[many] &= kept
    i, j = np.nonzero(hit)
    return i + first, j + a, near[i, j]


def _window_task(width: int, k: int, window: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, unit, done = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, width), np.float32), 0

        def finish(upto: int) -> Iterator[pa.RecordBatch]:
            for first in range(done, upto, TILE):
                i, j, cosine = _tile(part, unit, first, min(upto, first + TILE), k, window, least)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(cosine.astype(np.float32))], names=["g", "i", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("s").to_pylist()), np.int8).reshape(-1, width)
            ids = np.concatenate([ids, batch.column("no").to_numpy()])
            part = np.concatenate([part, batch.column("part").to_numpy()])
            unit = np.concatenate([unit, _unit(sketch).astype(np.float32)])
            upto = max(done, len(unit) - window)
            yield from finish(upto)
            drop = max(0, upto - window)
            ids, part, unit, done = ids[drop:], part[drop:], unit[drop:], upto - drop
        if len(ids):
            yield from finish(len(unit))

    return run


def _cosine_task(width: int, out: list[str]):
    """Adds the exact cosine of the two vectors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), pa.array(np.einsum("ij,ij->i", a, b))], names=out)

    return run


def usable(vectors: DataFrame, embedding: str, width: int) -> DataFrame:
    """The rows whose vector has the given width and only finite components, not all of them zero."""
    v = F.col(embedding)
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, item: str = "chunk_id", embedding: str = "embedding", width: int = 64, k: int = 5, least: float = -1.0, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """The k most similar other rows of each row, by cosine: (item, other, cosine, place).

    Only rows with a non-null id and a vector of ``width`` finite components, not all zero, take part; ids must be
    unique, of repeated ids one row holds. Neighbours with a cosine not above ``least`` are left out. Equal cosines
    go by id. Equal vectors are one vector in the search: the copies are each other's nearest, and each gets the k
    it needs, never all pairs. An empty table gives no rows. The search is approximate in which neighbours it sees,
    exact in their cosines; a test of recall against brute force stands in the tests and in the README.

    Along the curves travels one byte per component, range-partitioned by the place on the curve, so that neighbours
    on a curve stand together whatever their density; windows of fixed width make the work linear in the rows. The
    k + SPARE best of all windows by the approximate cosine (MARGIN holds its error) are then compared exactly, for
    which the vectors are joined to the pairs.
    """
    kind = vectors.schema[item].dataType
    rows = usable(vectors, embedding, width).select(F.col(item).alias("id"), F.transform(embedding, lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("v")).where("id is not null")
    rows = stored(rows)
    # read by the fit, by the search, by the reranking and for the copies; numbers are shorter than ids
    classes = stored(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()))
    sample = classes.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(FIT_ROWS).select("v").toArrow()["v"]  # the lowest hashes
    unit = _unit(sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.float32)
    ranges = -(-parallelism(vectors.sparkSession) // curves)
    index = CurveIndex(unit, width, curves, ranges)
    keyed = classes.select("no", "v").mapInArrow(_key_task(index, width), "part int, key long, no long, s binary")
    ranged = keyed.repartitionById(curves * ranges, F.col("part")).sortWithinPartitions("part", "key", "no")
    seen = ranged.mapInArrow(_window_task(width, k + SPARE, window, least), "g long, i long, s float").repartition("g")
    some = seen.mapInArrow(heap_task(k + SPARE, False), "g long, i long, s float")
    # each unordered pair is compared once
    pairs = some.select(F.least("g", "i").alias("g"), F.greatest("g", "i").alias("i")).distinct()
    own = classes.select(F.col("no").alias("g"), F.col("v").alias("a"))
    both = pairs.join(own, "g").join(own.select(F.col("g").alias("i"), F.col("a").alias("b")), "i")
    exact = both.select("g", "i", "a", "b").mapInArrow(_cosine_task(width, ["g", "i", "s"]), "g long, i long, s double").where(F.col("s") > least)
    names = classes.select(F.col("no").alias("g"), F.col("id"))
    named = exact.join(names, "g").select(F.col("id").alias("x"), "i", "s").join(names.select(F.col("g").alias("i"), "id"), "i").select("x", F.col("id").alias("y"), "s")
    directed = named.select(F.explode(F.array(F.struct(F.col("x").alias("g"), F.col("y").alias("i")), F.struct(F.col("y").alias("g"), F.col("x").alias("i")))).alias("p"), "s").select("p.g", "p.i", "s")
    best = directed.repartition("g").mapInArrow(heap_task(k, True), T.StructType([T.StructField("g", kind), T.StructField("i", kind), T.StructField("s", T.DoubleType()), T.StructField("place", T.LongType())]))
    return _with_copies(rows, classes.where("n > 1").select("v", F.col("id").alias("g")), best, item, k, least)


def _with_copies(rows: DataFrame, repeated: DataFrame, best: DataFrame, item: str, k: int, least: float) -> DataFrame:
    """Neighbours of rows from those of classes of equal vectors."""
    members = rows.join(repeated.select("v", "g"), "v").select("g", "id")
    first = members.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(F.col("p") <= k + 1)
    lists = first.groupBy("g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    others = best.join(lists.withColumnRenamed("g", "i"), "i", "left").select("g", F.explode(F.coalesce("ids", F.array("i"))).alias("other"), "s")
    if least < 1:
        others = others.unionByName(lists.select("g", F.explode("ids").alias("other"), F.lit(1.0).alias("s")))
    # bounded: at most k classes of k + 1 members each, and the class's own
    choice = others.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), F.col("other")))).alias("choice"))
    # an inner join, of which AQE may split either side: a class may hold a third of all rows
    several = members.join(choice, "g").select("id", "choice")
    single = choice.join(repeated.select("g"), "g", "left_anti").select(F.col("g").alias("id"), "choice")
    wanted = several.unionByName(single)
    kept = wanted.select("id", F.slice(F.filter("choice", lambda c: c["other"] != F.col("id")), 1, k).alias("kept"))
    return kept.select("id", F.posexplode("kept").alias("at", "c")).select(F.col("id").alias(item), F.col("c.other").alias("other"), (-F.col("c.m")).alias("cosine"), (F.col("at") + 1).alias("place"))


def current_vectors(records: DataFrame) -> DataFrame:
    """One row per chunk, of its highest generation: (chunk_id, embedding); repeated rows of it count once."""
    base = records.select("chunk_id", F.coalesce("generation", F.lit(-(2**63))).alias("generation"), "embedding").where("chunk_id is not null")
    return base.groupBy("chunk_id").agg(F.max(F.struct("generation", "embedding")).alias("last")).select("chunk_id", "last.embedding")
