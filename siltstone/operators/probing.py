"""More on signatures: weighted and asymmetric scores, budgeted probes, band layouts, masks, counters, routing, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.vector import hamming, pack
from siltstone.operators.lexical import top_k
from siltstone.operators.signatures import bit, bit_counts, bucket_keys, probe_masks, tiled


def asymmetric_scores(candidates: DataFrame, projected_queries: DataFrame, bits: int) -> DataFrame:
    """(query, item, score): the query's projections added where the item's bit is set and subtracted where not."""
    signs = F.array(*[(2 * bit(F.col("words"), i) - 1).cast("double") for i in range(bits)])
    score = F.aggregate(F.zip_with(signs, "projections", lambda s, p: s * p), F.lit(0.0), lambda a, v: a + v)
    return candidates.join(projected_queries.select(F.col("id").alias("query"), "projections"), "query").select("query", "item", score.alias("score"))


def weighted_hamming(a: Column, b: Column, weights: list[float]) -> Column:
    """Sum of the weights of differing bits; the weights are scaled to a mean of 1."""
    scale = len(weights) / sum(weights)
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        differs = F.array(a[i // 64].bitwiseXOR(b[i // 64]))
        total = total + bit(differs, i % 64) * F.lit(w * scale)
    return total


def _weighted_task(words: int, weights: list[float], k: int, digits: int):
    scaled = np.array(weights, float) * (len(weights) / sum(weights))

    def bits(column: pa.Array) -> np.ndarray:
        w = np.array(column.flatten().to_numpy(), np.int64).reshape(-1, words)
        return np.unpackbits(w.view(np.uint8), axis=1, bitorder="little")[:, : len(scaled)].astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, d = batch.column("qids")[row].values, batch.column("ids")[row].values
                order = np.argsort(d.to_numpy(zero_copy_only=False), kind="stable")
                a, b = bits(batch.column("qwords")[row].values), bits(batch.column("words")[row].values)[order]
                for at in range(0, len(a), 64):
                    part = a[at : at + 64] * scaled
                    # a bit differs where one side has it and not both
                    gap = part.sum(1)[:, None] + (b @ scaled)[None, :] - 2 * (part @ b.T)
                    score = np.round(-gap, digits) + 0.0
                    best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    i = np.repeat(np.arange(len(part)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(i + at)), d.take(pa.array(order[best.ravel()])), pa.array(score[i, best.ravel()])], names=["query", "item", "score"])

    return run


def weighted_hamming_top_k(signatures: DataFrame, queries: DataFrame, weights: list[float], k: int = 10, digits: int = 6, tile: int = 4096) -> DataFrame:
    """(query, item, score, rank): the k other signatures of least weighted_hamming among all, as a negated, rounded score, ties by id."""
    kind = signatures.schema["id"].dataType
    pairs = tiled(signatures, "ids", "words", tile).crossJoin(tiled(queries, "qids", "qwords", tile))
    out = T.StructType([T.StructField("query", kind), T.StructField("item", kind), T.StructField("score", T.DoubleType())])
    near = pairs.mapInArrow(_weighted_task((len(weights) + 63) // 64, weights, k, digits), out).where("query <> item")
    return top_k(near, "query", "item", "score", k)


def budgeted_candidates(signatures: DataFrame, query_signatures: DataFrame, costs: DataFrame, bits: int, budget: int, tables: int = 8, width: int = 8, radius: int = 2) -> DataFrame:
    """(query, item): candidates from probes in the order of their cost, until ``budget`` distinct ones are met.

    ``costs`` is (id, costs): for each query what flipping each bit costs, e.g. its projection's size. Exact buckets
    are always looked into; the others go by the summed cost of their flips, then table and key, and the probe at
    which the distinct candidates reach the budget is the last. Each item counts for the first probe that meets it.
    """
    source = [[(t * width + o) * bits // (tables * width) for o in range(width)] for t in range(tables)]
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m"), F.array(*[F.lit(source[t][o]) for o in range(width) if m >> o & 1]).cast("array<int>").alias("flips")) for t in range(tables) for _, m in probe_masks(width, radius)])
    keys = bucket_keys(query_signatures, bits, tables, width).join(costs, "id")
    per_table = F.filter(masks, lambda p: p["t"] == F.col("table"))
    asked = keys.select(F.col("id").alias("query"), "table", "key", "costs", F.explode(per_table).alias("p"))
    cost = F.aggregate("p.flips", F.lit(0.0), lambda s, i: s + F.col("costs")[i])
    probes = asked.select("query", "table", F.col("key").bitwiseXOR(F.col("p.m")).alias("key"), F.when(F.size("p.flips") == 0, F.lit(-1.0)).otherwise(cost).alias("cost"))
    order = Window.partitionBy("query").orderBy("cost", "table", "key")
    numbered = probes.withColumn("n", F.when(F.col("cost") < 0, 0).otherwise(F.row_number().over(order)))
    first = numbered.join(bucket_keys(signatures, bits, tables, width), ["table", "key"]).groupBy("query", "id").agg(F.min("n").alias("n"))
    per = first.groupBy("query", "n").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("query").orderBy("n")))
    last = per.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("upto") >= budget, F.col("n"))), F.max("n")).alias("last"))
    return first.join(last, "query").where("n <= last").select("query", F.col("id").alias("item"))


def band_layout(signatures: DataFrame, bits: int, bands: int) -> list[list[int]]:
    """Bits dealt to bands so that correlated ones part: by falling entropy, each to the band that it correlates with least."""
    from siltstone.operators.signatures import bit_correlations

    one = bit_counts(signatures, bits).first()
    p = np.array(one["ones"]) / max(1, one["n"])
    h = -(p * np.log2(np.where(p > 0, p, 1)) + (1 - p) * np.log2(np.where(p < 1, 1 - p, 1)))
    c = np.zeros((bits, bits))
    for r in bit_correlations(signatures, bits, None).collect():  # bits x bits numbers
        c[r["a"], r["b"]] = c[r["b"], r["a"]] = abs(r["correlation"])
    out: list[list[int]] = [[] for _ in range(bands)]
    for i in np.argsort(-h, kind="stable"):
        open_ = [b for b in range(bands) if len(out[b]) < bits // bands]
        best = min(open_, key=lambda b: (c[i, out[b]].mean() if out[b] else 0.0, len(out[b]), b))
        out[best].append(int(i))
    return out


def intraband_correlation(correlations: DataFrame, layout: list[list[int]]) -> DataFrame:
    """(band, correlation): mean size of the correlations between the bits of each band."""
    spark = correlations.sparkSession
    place = spark.createDataFrame([(i, b) for b, own in enumerate(layout) for i in own], "bit long, band int")
    both = correlations.join(F.broadcast(place.select(F.col("bit").alias("a"), "band")), "a").join(F.broadcast(place.select(F.col("bit").alias("b"), F.col("band").alias("other"))), "b")
    return both.where("band = other").groupBy("band").agg(F.avg(F.abs("correlation")).alias("correlation"))


def masked_signatures(vectors: DataFrame, item: str, vector: str, width: int, share: float = 0.5) -> DataFrame:
    """(id, words, mask): sign bits, and a mask of the components that lie farther out than their dimension's quantile."""
    spread = vectors.where(F.size(vector) == width).select(F.posexplode(vector).alias("dim", "x"))
    cuts = spread.groupBy("dim").agg(F.expr(f"percentile_disc({share}) within group (order by abs(x))").alias("cut"))
    row = cuts.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "cut"))), lambda s: s["cut"]).alias("cuts"))  # one number per dimension
    v = F.col(vector)
    far = F.zip_with(v, "cuts", lambda x, c: (F.abs(x) > c).cast("long"))
    up = F.transform(v, lambda x: (x > 0).cast("long"))
    return vectors.where(F.size(v) == width).crossJoin(F.broadcast(row)).select(F.col(item).alias("id"), pack(up, width).alias("words"), pack(far, width).alias("mask"))


def masked_distance(a: Column, b: Column, mask_a: Column, mask_b: Column, words: int) -> Column:
    """Differing bits among those that both sides are sure of."""
    total = None
    for w in range(words):
        part = F.bit_count(a[w].bitwiseXOR(b[w]).bitwiseAND(mask_a[w]).bitwiseAND(mask_b[w]))
        total = part if total is None else total + part
    return total


def updated_counters(counters: DataFrame, changes: DataFrame, bits: int, key: str) -> DataFrame:
    """(key, n, ones) after signatures are added (sign 1) and removed (sign -1): ``changes`` is (key, words, sign).

    Counts are sums, so a group's aggregate signature follows its changes without reading its other members.
    """
    sums = [F.sum(bit(F.col("words"), i) * F.col("sign")).alias(f"_{i}") for i in range(bits)]
    delta = changes.groupBy(key).agg(F.sum("sign").alias("n"), *sums).select(key, "n", F.array(*[f"_{i}" for i in range(bits)]).alias("ones"))
    parts = counters.select(key, "n", "ones").unionByName(delta)
    return parts.groupBy(key).agg(F.sum("n").cast("long").alias("n"), *[F.sum(F.col("ones")[i]).alias(f"_{i}") for i in range(bits)]).select(key, "n", F.array(*[f"_{i}" for i in range(bits)]).alias("ones")).where("n > 0")


def route_groups(query_signatures: DataFrame, group_signatures: DataFrame, key: str, words: int, k: int) -> DataFrame:
    """(query, key, distance): the k groups whose aggregate signatures are nearest; groups are few against their members."""
    pairs = query_signatures.select(F.col("id").alias("query"), F.col("words").alias("q")).crossJoin(group_signatures)
    near = pairs.select("query", key, hamming(F.col("q"), F.col("words"), words).cast("long").alias("distance"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).where(F.col("r") <= k).drop("r")


def hash_order(rows: DataFrame, item: str, salt: str) -> Column:
    """What a stable split orders by: SHA-256 of salt, separator and id, in hex."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\u0000"), F.col(item).cast("string")), 256)


def hash_split(rows: DataFrame, item: str, salt: str, share: float) -> DataFrame:
    """Adds ``held_out``: the first 32 bits of each row's own hash, as a fraction, are below the share."""
    first = F.conv(F.substring(hash_order(rows, item, salt), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("held_out", first < share)


def sparse_signatures(values: DataFrame, rows: np.ndarray) -> DataFrame:
    """(id, words) from (id, index, value) rows, with the bits that the dense vectors would have.

    The projection matrix is bits x dimensions numbers; partial products are added by id, so a long vector may be
    spread over tasks.
    """
    bits = len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").dictionary_encode()
            code = ids.indices.to_numpy()
            part = np.zeros((len(ids.dictionary), bits))
            np.add.at(part, code, rows.T[b.column("index").to_numpy()] * b.column("value").to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([ids.dictionary, pa.array(list(part), pa.list_(pa.float64()))], names=["id", "part"])

    kind = values.schema["id"].dataType
    parts = values.select("id", F.col("index").cast("int").alias("index"), F.col("value").cast("double").alias("value")).where("value is not null and index is not null").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("part", T.ArrayType(T.DoubleType()))]))
    sums = parts.groupBy("id").agg(*[F.sum(F.col("part")[i]).alias(f"_{i}") for i in range(bits)])
    return sums.select("id", pack(F.array(*[(F.col(f"_{i}") > 0).cast("long") for i in range(bits)]), bits).alias("words"))

