"""Binary signatures: encoders, Hamming search, multi-probe and banded candidates, aggregates and code health."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.vector import hadamard_rows, hamming, hyperplanes, pack, sign_bits
from siltstone.operators.lexical import top_k
from siltstone.session import cut, stored

#: Tables and sampled bits of each, candidates asked for per result and at least, and the largest probe radius.
TABLES, TABLE_BITS, MULTIPLIER, LEAST, RADIUS = 8, 8, 64, 128, 2
#: Rows that encoders are fitted on at most, as a documented sample; all rows are encoded.
FIT_ROWS = 2048


def sign_signatures(vectors: DataFrame, item: str, vector: str, width: int) -> DataFrame:
    """(id, words): one bit per component, set where it is above 0."""
    fine = vectors.where((F.size(vector) == width) & F.col(item).isNotNull())
    return fine.select(F.col(item).alias("id"), pack(sign_bits(F.col(vector)), width).alias("words"))


class LinearEncoder:
    """bit i is set where row i's product with a vector exceeds its threshold (or reaches it, for ``closed``)."""

    def __init__(self, name: str, rows: np.ndarray, thresholds: np.ndarray | None = None, closed: bool = False):
        self.name, self.rows, self.closed = name, np.asarray(rows, float), closed
        self.thresholds = np.zeros(len(rows)) if thresholds is None else np.asarray(thresholds, float)

    def projections(self, x: np.ndarray) -> np.ndarray:
        return x.astype(float) @ self.rows.T

    def words(self, x: np.ndarray) -> np.ndarray:
        p = self.projections(x)
        bits = p >= self.thresholds if self.closed else p > self.thresholds
        padded = np.zeros((len(bits), (bits.shape[1] + 63) // 64 * 64), np.uint8)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<i8")

    def encode(self, vectors: DataFrame, item: str, vector: str, projections: bool = False) -> DataFrame:
        """(id, words) and, when asked for, the projections; rows of another width are left out."""
        kind, width = vectors.schema[item].dataType, self.rows.shape[1]
        fields = [T.StructField("id", kind), T.StructField("words", T.ArrayType(T.LongType()))]
        if projections:
            fields.append(T.StructField("projections", T.ArrayType(T.DoubleType())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                out = [batch.column("id"), pa.array(list(self.words(x)), pa.list_(pa.int64()))]
                if projections:
                    out.append(pa.array(list(self.projections(x)), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

        narrow = vectors.select(F.col(item).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(f"id is not null and size(v) = {width} and forall(v, x -> x is not null)")
        return narrow.mapInArrow(run, T.StructType(fields))


def random_hyperplanes(bits: int, width: int, seed: int = 42) -> LinearEncoder:
    return LinearEncoder("hyperplane", hyperplanes(bits, width, seed))


def randomized_hadamard(bits: int, width: int, seed: int = 42) -> LinearEncoder:
    return LinearEncoder("hadamard", hadamard_rows(bits, width, seed))


def autoencoder(weights: np.ndarray, bias: np.ndarray) -> LinearEncoder:
    """Given weights and bias: bit set where weights x + bias is at least 0."""
    return LinearEncoder("autoencoder", weights, -np.asarray(bias, float), closed=True)


def decode(bits: np.ndarray, weights: np.ndarray, bias: np.ndarray, signed: bool = True, squash: bool = False) -> np.ndarray:
    """Vectors back from bits: bias plus weights times bits as -1 and 1 (or 0 and 1), through tanh when asked for."""
    x = np.asarray(bias) + (2.0 * bits - 1 if signed else bits.astype(float)) @ np.asarray(weights).T
    return np.tanh(x) if squash else x


def fit_sample(vectors: DataFrame, item: str, vector: str, size: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    """The rows of the ``size`` lowest hashes of id and seed: bounded, and the same however the data is split."""
    rows = vectors.where(F.size(vector) > 0).orderBy(F.xxhash64(F.col(item), F.lit(seed)), item).limit(size).select(vector).collect()
    return np.array([r[0] for r in rows], float)


def _lower_median(p: np.ndarray) -> np.ndarray:
    return np.sort(p, axis=0)[(len(p) - 1) // 2]


def _principal(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:bits]
    return mean, axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]


def pca(x: np.ndarray, bits: int) -> LinearEncoder:
    """Principal axes, each split at the lower median of the sample's projections; at most one bit a dimension."""
    _, axes = _principal(x, bits)
    return LinearEncoder("pca", axes, _lower_median(x @ axes.T))


def itq(x: np.ndarray, bits: int, rounds: int = 16) -> LinearEncoder:
    """Principal axes turned so that the sample lies near the corners of the cube, by alternating least squares."""
    mean, axes = _principal(x, bits)
    v = (x - mean) @ axes.T
    turn = np.eye(len(axes))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
        turn = u @ w
    rows = turn.T @ axes
    return LinearEncoder("itq", rows, rows @ mean)


def pair_differences(x: np.ndarray, bits: int, seed: int = 42, candidates: int = 16) -> LinearEncoder:
    """Directions from one sampled vector to the farthest of some others, split at the lower median."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(bits):
        a, *others = rng.integers(0, len(x), candidates + 1)
        gaps = x[a] - x[others]
        best = gaps[np.linalg.norm(gaps, axis=1).argmax()]
        norm = np.linalg.norm(best)
        rows.append(best / norm if norm > 0 else rng.choice([-1.0, 1.0], x.shape[1]) / np.sqrt(x.shape[1]))
    rows = np.array(rows)
    return LinearEncoder("pairs", rows, _lower_median(x @ rows.T))


def _ham_task(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, d = batch.column("qids")[row].values, batch.column("ids")[row].values
                a = np.array(batch.column("qwords")[row].values.flatten().to_numpy(), np.uint64).reshape(-1, words)
                b = np.array(batch.column("words")[row].values.flatten().to_numpy(), np.uint64).reshape(-1, words)
                order = np.argsort(d.to_numpy(zero_copy_only=False), kind="stable")
                b = b[order]
                for at in range(0, len(a), 64):
                    part = a[at : at + 64]
                    gap = np.bitwise_count(part[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                    best = np.argsort(gap, axis=1, kind="stable")[:, : k + 1]
                    i = np.repeat(np.arange(len(part)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(i + at)), d.take(pa.array(order[best.ravel()])), pa.array(gap[i, best.ravel()])], names=["query", "item", "distance"])

    return run


def tiled(signatures: DataFrame, ids: str, words: str, tile: int) -> DataFrame:
    """(ids, words): rows of up to ``tile`` signatures each, as arrays."""
    numbered = signatures.withColumn("t", F.spark_partition_id() * F.lit(1 << 20) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / tile))
    return numbered.groupBy("t").agg(F.collect_list(F.struct("id", "words")).alias("r")).select(F.col("r.id").alias(ids), F.col("r.words").alias(words))


def hamming_top_k(signatures: DataFrame, queries: DataFrame, words: int, k: int = 10, tile: int = 4096) -> DataFrame:
    """(query, item, distance, rank): the k nearest other signatures of each query, ties by id; tiles of both sides."""
    kind = signatures.schema["id"].dataType
    pairs = tiled(signatures, "ids", "words", tile).crossJoin(tiled(queries, "qids", "qwords", tile))
    out = T.StructType([T.StructField("query", kind), T.StructField("item", kind), T.StructField("distance", T.LongType())])
    near = pairs.mapInArrow(_ham_task(words, k), out).where("query <> item")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "item")))
    return ranked.where(F.col("rank") <= k)


def bit(words: Column, index: int) -> Column:
    return F.shiftrightunsigned(words[index // 64], index % 64).bitwiseAND(F.lit(1).cast("long"))


def bucket_keys(signatures: DataFrame, bits: int, tables: int = TABLES, width: int = TABLE_BITS) -> DataFrame:
    """(id, table, key): a key of ``width`` bits for each table, sampled evenly over the signature."""
    keys = []
    for t in range(tables):
        key = F.lit(0).cast("long")
        for o in range(width):
            key = key.bitwiseOR(F.shiftleft(bit(F.col("words"), (t * width + o) * bits // (tables * width)), o))
        keys.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    return signatures.select("id", F.explode(F.array(*keys)).alias("k")).select("id", "k.table", "k.key")


def probe_masks(width: int, radius: int) -> list[tuple[int, int]]:
    """(radius, mask) of all keys within the radius."""
    return [(r, sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(width), r)]


def probes(query_signatures: DataFrame, bits: int, tables: int = TABLES, width: int = TABLE_BITS, radius: int = RADIUS) -> DataFrame:
    """(query, table, key, radius) of every bucket that a query looks into."""
    masks = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(m).cast("long").alias("m")) for r, m in probe_masks(width, radius)])
    keys = bucket_keys(query_signatures, bits, tables, width)
    return keys.select(F.col("id").alias("query"), "table", "key", F.explode(masks).alias("p")).select("query", "table", F.col("key").bitwiseXOR(F.col("p.m")).alias("key"), F.col("p.r").alias("radius"))


def multiprobe(signatures: DataFrame, query_signatures: DataFrame, bits: int, k: int = 10, tables: int = TABLES, width: int = TABLE_BITS, radius: int = RADIUS, multiplier: int = MULTIPLIER, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Top k among bucket candidates, and diagnostics: (query, item, distance, rank), (query, buckets, postings, candidates).

    A query's candidates are what it meets up to the first whole radius at which they are at least
    min(rows, max(least, k * multiplier)), itself included, else up to the largest radius.

    The largest radius, which has most of the probes, is only looked into for the queries that aren't full before.
    ``width`` should be about the logarithm of the rows, so that a bucket holds a few of them.
    """
    postings = bucket_keys(signatures, bits, tables, width)
    asked = probes(query_signatures, bits, tables, width, radius)
    goal = F.least(F.col("n"), F.lit(max(least, k * multiplier)))
    rows = signatures.agg(F.count("*").alias("n"))
    near = stored(asked.where(F.col("radius") < max(radius, 1)).join(postings, ["table", "key"]).select("query", "id", "radius"))
    first = near.groupBy("query", "id").agg(F.min("radius").alias("radius")).groupBy("query", "radius").agg(F.count("*").alias("c"))
    upto = first.withColumn("c", F.sum("c").over(Window.partitionBy("query").orderBy("radius"))).crossJoin(F.broadcast(rows))
    full = upto.where(F.col("c") >= goal).groupBy("query").agg(F.min("radius").alias("stop"))
    far = asked.where((F.col("radius") == radius) & F.lit(radius > 0)).join(full, "query", "left_anti").join(postings, ["table", "key"]).select("query", "id", "radius")
    met = near.join(full, "query", "left").where("stop is null or radius <= stop").select("query", "id").unionByName(far.select("query", "id"))
    stop = query_signatures.select(F.col("id").alias("query")).join(full, "query", "left").select("query", F.coalesce("stop", F.lit(radius)).alias("stop"))
    scored = met.select("query", "id").distinct().join(signatures, "id").join(query_signatures.select(F.col("id").alias("query"), F.col("words").alias("qwords")), "query")
    scored = scored.select("query", F.col("id").alias("item"), hamming(F.col("words"), F.col("qwords"), (bits + 63) // 64).cast("long").alias("distance")).where("query <> item")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "item"))).where(F.col("rank") <= k)
    counts = F.array(*[F.lit(tables * sum(1 for r, _ in probe_masks(width, radius) if r <= q)) for q in range(radius + 1)])
    visited = met.groupBy("query").agg(F.count("*").alias("postings"), F.countDistinct("id").alias("candidates"))
    return ranked, stop.join(visited, "query").select("query", counts[F.col("stop")].cast("long").alias("buckets"), "postings", "candidates")


def band_candidates(signatures: DataFrame, query_signatures: DataFrame, bits: int, bands: int, radius: int) -> DataFrame:
    """(query, item): all signatures within a Hamming radius, and some others, by the pigeonhole rule.

    With (q, r) = divmod(radius, bands), the first r + 1 bands are probed to q and the rest to q - 1 (not at all for
    q = 0): of two signatures within the radius, some band differs by no more.
    """
    width = bits // bands
    q, r = divmod(radius, bands)

    def band(b: int) -> Column:
        start = b * width
        word = F.shiftrightunsigned(F.col("words")[start // 64], start % 64)
        return word.bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    if 64 % width:
        raise ValueError("bands must not straddle words")
    keys = F.array(*[F.struct(F.lit(b).alias("band"), band(b).alias("key")) for b in range(bands)])
    stored = signatures.select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.key")
    masks = F.array(*[F.struct(F.lit(d).alias("r"), F.lit(m).cast("long").alias("m")) for d, m in probe_masks(width, q)])
    asked = query_signatures.select(F.col("id").alias("query"), F.explode(keys).alias("k")).select("query", "k.band", "k.key", F.explode(masks).alias("p"))
    asked = asked.where(F.col("p.r") <= F.when(F.col("band") <= r, q).otherwise(q - 1)).select("query", "band", F.col("key").bitwiseXOR(F.col("p.m")).alias("key"))
    return asked.join(stored, ["band", "key"]).select("query", F.col("id").alias("item")).where("query <> item").distinct()


def band_spans(bits: int, bands: int) -> list[tuple[int, int]]:
    """(first bit, width) of bands that differ in width by one at most, the wider ones first."""
    base, more = divmod(bits, bands)
    spans, at = [], 0
    for b in range(bands):
        width = base + (b < more)
        spans.append((at, width))
        at += width
    return spans


def _span_key(first: int, width: int) -> Column:
    """The bits of a band as one number, also where the band goes over into the next word."""
    word, at = divmod(first, 64)
    mask = F.lit((1 << width) - 1).cast("long")
    low = F.shiftrightunsigned(F.col("words")[word], at)
    if at + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col("words")[word + 1], 64 - at))
    return low.bitwiseAND(mask)


def spanned_candidates(signatures: DataFrame, query_signatures: DataFrame, spans: list[tuple[int, int]], radius: int) -> DataFrame:
    """(query, item): all signatures within a Hamming radius, and some others, over bands of any widths below 63.

    By the pigeonhole rule of ``band_candidates``, each band probed within its share of the radius.
    """
    q, r = divmod(radius, len(spans))
    keys = F.array(*[F.struct(F.lit(b).alias("band"), _span_key(*s).alias("key")) for b, s in enumerate(spans)])
    own = lambda b, width: F.array(*[F.lit(m).cast("long") for _, m in probe_masks(width, q if b <= r else q - 1)] if q or b <= r else []).cast("array<bigint>")
    masks = F.array(*[own(b, width) for b, (_, width) in enumerate(spans)])
    stored_ = signatures.select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.key")
    asked = query_signatures.select(F.col("id").alias("query"), F.explode(keys).alias("k")).select("query", "k.band", F.col("k.key").alias("own"), F.explode(masks[F.col("k.band")]).alias("m"))
    asked = asked.select("query", "band", F.col("own").bitwiseXOR(F.col("m")).alias("key"))
    return asked.join(stored_, ["band", "key"]).select("query", F.col("id").alias("item")).where("query <> item").distinct()


def spread_bits(signatures: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, bit, value): a row per bit."""
    rows = F.array(*[F.struct(F.lit(i).alias("bit"), bit(F.col("words"), i).alias("value")) for i in range(bits)])
    return signatures.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.bit", "b.value")


def bit_counts(signatures: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, n, ones): how many signatures and, as an array, how many have each bit; one row per key, no explode."""
    sums = [F.sum(bit(F.col("words"), i)).alias(f"_{i}") for i in range(bits)]
    return signatures.groupBy(*keys).agg(F.count("*").alias("n"), *sums).select(*keys, "n", F.array(*[f"_{i}" for i in range(bits)]).alias("ones"))


def aggregate_signatures(signatures: DataFrame, bits: int, key: str, rule: str, share: float = 0.5) -> DataFrame:
    """(key, words): one signature of each group. any: some has the bit; all: all have it; majority: at least half,
    rounded up; threshold: at least ``share`` of them, rounded up. The first two are bitwise aggregates."""
    words = (bits + 63) // 64
    if rule in ("any", "all"):
        f = F.bit_or if rule == "any" else F.bit_and
        return signatures.groupBy(key).agg(F.array(*[f(F.col("words")[w]) for w in range(words)]).alias("words"))
    counted = bit_counts(signatures, bits, key)
    goal = F.ceil(F.col("n") * F.lit(0.5 if rule == "majority" else share))
    return counted.select(key, pack(F.transform("ones", lambda o: (o >= goal).cast("long")), bits).alias("words"))


def entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def code_health(signatures: DataFrame, bits: int) -> DataFrame:
    """One row on the bits: share of constant ones, entropy in total, mean, least, most, and at 5, 50 and 95 percent.

    The percentiles take the value at floor(share * (bits - 1)) of the sorted entropies.
    """
    e = F.expr("array_sort(e)")
    shares = bit_counts(signatures, bits).select(F.transform("ones", lambda o: o / F.col("n")).alias("p")).select(F.transform("p", entropy).alias("e"), F.filter("p", lambda p: (p <= 0) | (p >= 1)).alias("still"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    at = {f"p{int(q * 100):02d}": int(q * (bits - 1)) for q in (0.05, 0.5, 0.95)}
    return shares.select((F.size("still") / bits).alias("constant_fraction"), total.alias("entropy_total"), (total / bits).alias("entropy_mean"), F.array_min("e").alias("entropy_min"), F.array_max("e").alias("entropy_max"), *[e[i].alias(f"entropy_{n}") for n, i in at.items()])


def strided(rows: DataFrame, item: str, size: int) -> DataFrame:
    """At most ``size`` rows at even steps in the order of their ids: those numbered floor(i * rows / size)."""
    from siltstone.operators.ranking import numbered

    placed = numbered(rows, [item], "_no")
    n = placed.agg(F.count("*").alias("_n"))
    at = F.ceil(F.col("_no") * F.least(F.col("_n"), F.lit(size)) / F.col("_n"))
    chosen = (at < F.least(F.col("_n"), F.lit(size))) & (F.floor(at * F.col("_n") / F.least(F.col("_n"), F.lit(size))) == F.col("_no"))
    return placed.crossJoin(F.broadcast(n)).where(chosen).drop("_no", "_n")


def bit_correlations(signatures: DataFrame, bits: int, sample: int | None = 512) -> DataFrame:
    """(a, b, correlation) of each pair of bits that vary, over at most ``sample`` rows at even steps (all if None).

    The counts of all pairs come from one aggregate over products of sign matrices, bits x bits numbers.
    """
    some = signatures if sample is None else strided(signatures, "id", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((bits, bits), np.int64), 0
        for batch in batches:
            w = np.array(batch.column("words").flatten().to_numpy(), np.int64).reshape(batch.num_rows, -1)
            x = np.unpackbits(w.view(np.uint8), axis=1, bitorder="little")[:, :bits].astype(np.int64)
            both += x.T @ x
            n += len(x)
        if n:
            i, j = np.triu_indices(bits)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j]), pa.array(np.full(len(i), n))], names=["a", "b", "c", "n"])

    counts = some.select("words").mapInArrow(run, "a long, b long, c long, n long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    single = counts.where("a = b").select("a", (F.col("c") / F.col("n")).alias("p"))
    pairs = counts.where("a < b").join(single.withColumnRenamed("p", "pa"), "a").join(single.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
    return pairs.where("pa > 0 and pa < 1 and pb > 0 and pb < 1").select("a", "b", ((F.col("c") / F.col("n") - F.col("pa") * F.col("pb")) / F.sqrt(F.col("pa") * (1 - F.col("pa")) * F.col("pb") * (1 - F.col("pb")))).alias("correlation"))


def correlation_summary(correlations: DataFrame, bits: int) -> DataFrame:
    """One row: mean, 95th and 99th percentile and largest size of the correlations, at floor(share * (count - 1))."""
    sizes = correlations.select(F.abs("correlation").alias("c"))
    one = sizes.agg(F.sort_array(F.collect_list("c")).alias("c"), F.avg("c").alias("mean"))  # bits x bits numbers at most
    at = lambda q: F.col("c")[F.floor(F.lit(q) * (F.size("c") - 1)).cast("int")]
    return one.select("mean", at(0.95).alias("p95"), at(0.99).alias("p99"), F.array_max("c").alias("largest"))


def signature_buckets(signatures: DataFrame) -> DataFrame:
    """(words, size) of every distinct signature."""
    return signatures.groupBy("words").agg(F.count("*").alias("size"))


#: The step and the offset, before they are reduced, by which the reference samples pairs; the same pairs
#: must come out.
PAIR_STEP, PAIR_OFFSET = 1099511628211, 1469598103934665603


def pairwise_stats(signatures: DataFrame, words: int, limit: int = 4096) -> DataFrame:
    """One row: pairs, mean, standard deviation, least and most Hamming distance over at most ``limit`` pairs.

    Signatures are numbered by id and their M pairs in order; all count up to the limit, else those at
    (offset + i * step) mod M with a step that has no divisor with M. The pairs are made in the executors, and only the
    rows that one of them names are joined.
    """
    from siltstone.operators.ranking import numbered

    rows = numbered(signatures, ["id"], "no")
    n = rows.count()
    total = n * (n - 1) // 2
    take = min(limit, total)
    step, offset = (PAIR_STEP % total or 1, PAIR_OFFSET % total) if take < total else (1, 0)
    while math.gcd(step, max(total, 1)) != 1:
        step = step + 1 if step + 1 < total else 1
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    r = (big(offset) + F.col("id").cast("decimal(38,0)") * big(step)) % big(max(total, 1))
    first = lambda a: a * (big(2 * n - 1) - a) / big(2)  # noqa: E731  # the number of the first pair of row a
    guess = F.floor((F.lit(2.0 * n - 1) - F.sqrt(F.greatest(F.lit(0.0), F.lit((2.0 * n - 1) ** 2) - 8 * F.col("r").cast("double")))) / 2).cast("long")
    near = F.array_max(F.filter(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda d: guess + d), lambda a: (a >= 0) & (a < n) & (first(a.cast("decimal(20,0)")) <= F.col("r"))))
    made = signatures.sparkSession.range(take).select(r.alias("r")).withColumn("a", near)
    pairs = made.select("a", (F.col("r") - first(F.col("a").cast("decimal(20,0)")) + F.col("a") + 1).cast("long").alias("b"))
    joined = pairs.join(rows.select(F.col("no").alias("a"), F.col("words").alias("wa")), "a").join(rows.select(F.col("no").alias("b"), F.col("words").alias("wb")), "b")
    d = hamming(F.col("wa"), F.col("wb"), words)
    return joined.select(d.alias("d")).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"), F.min("d").cast("long").alias("least"), F.max("d").cast("long").alias("most"))


def _distance_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(64 * words + 1, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                a = np.array(batch.column("qwords")[row].values.flatten().to_numpy(), np.uint64).reshape(-1, words)
                b = np.array(batch.column("words")[row].values.flatten().to_numpy(), np.uint64).reshape(-1, words)
                same = batch.column("t")[row].as_py() == batch.column("qt")[row].as_py()
                for at in range(0, len(a), 64):
                    gap = np.bitwise_count(a[at : at + 64, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                    # within one tile, each pair once
                    counts += np.bincount(gap[np.triu_indices(len(gap), at + 1, len(b))] if same else gap.ravel(), minlength=len(counts))
        d = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(counts[d])], names=["d", "n"])

    return run


def all_pairs_stats(signatures: DataFrame, words: int, tile: int = 4096) -> DataFrame:
    """One row: pairs, mean, standard deviation, least and most Hamming distance over all pairs, from one count of each distance."""
    own = cut(tiled(signatures, "ids", "words", tile).select(F.monotonically_increasing_id().alias("t"), "words"))
    pairs = own.crossJoin(own.select(F.col("t").alias("qt"), F.col("words").alias("qwords"))).where("qt <= t")
    counts = pairs.mapInArrow(_distance_task(words), "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ss"), F.min("d").alias("least"), F.max("d").alias("most"))
    mean = F.col("s") / F.col("pairs")
    return total.select("pairs", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("pairs") - mean * mean)).alias("deviation"), "least", "most")


def adc_scores(candidates: DataFrame, projected_queries: DataFrame, centers: np.ndarray) -> DataFrame:
    """(query, item, score): sum over bits of (the query's projection - center of the item's bit) squared, ascending.

    ``centers`` has the two mean projections of each bit; ``candidates`` is (query, item, words).
    """
    low, high = (F.array(*[F.lit(float(x)) for x in c]) for c in centers.T)
    bits = F.array(*[bit(F.col("words"), i) for i in range(len(centers))])
    gap = F.transform(F.arrays_zip(bits.alias("b"), low.alias("l"), high.alias("h"), F.col("projections").alias("p")), lambda z: F.pow(z["p"] - F.when(z["b"] == 1, z["h"]).otherwise(z["l"]), F.lit(2.0)))
    return candidates.join(projected_queries.select(F.col("id").alias("query"), "projections"), "query").select("query", "item", F.aggregate(gap, F.lit(0.0), lambda s, v: s + v).alias("score"))


def cascade(vectors: DataFrame, queries: DataFrame, item: str, vector: str, encoder: LinearEncoder, k1: int = 200, k2: int = 50, k: int = 10) -> DataFrame:
    """(query, item, score, rank): Hamming keeps k1, the asymmetric score k2 of these, exact cosine k of those."""
    from siltstone.functions.vector import dot, squared_norm

    words = (len(encoder.rows) + 63) // 64
    coded = encoder.encode(vectors, item, vector)
    asked = encoder.encode(queries, item, vector, projections=True)
    sample = fit_sample(vectors, item, vector)
    p = encoder.projections(sample)
    up = p > encoder.thresholds
    centers = np.stack([np.where((~up).any(0), (p * ~up).sum(0) / np.maximum(1, (~up).sum(0)), 0), np.where(up.any(0), (p * up).sum(0) / np.maximum(1, up.sum(0)), 0)], 1)
    near = hamming_top_k(coded, asked.select("id", "words"), words, k1).select("query", "item")
    scored = adc_scores(near.join(coded.withColumnRenamed("id", "item"), "item"), asked, centers)
    second = scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "item"))).where(F.col("r") <= k2).select("query", "item")
    a = queries.select(F.col(item).alias("query"), F.col(vector).alias("qv"))
    b = vectors.select(F.col(item).alias("item"), F.col(vector).alias("dv"))
    length = F.sqrt(squared_norm(F.col("qv")) * squared_norm(F.col("dv")))
    exact = second.join(a, "query").join(b, "item").select("query", "item", F.round(F.when(length > 0, dot(F.col("qv"), F.col("dv")) / length).otherwise(0.0), 6).alias("score"))
    return top_k(exact, "query", "item", "score", k)
