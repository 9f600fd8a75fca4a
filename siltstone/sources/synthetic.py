"""Generated inputs: lexical datasets of eight query classes, clustered vectors, a seeded stub retriever."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The query classes of the evaluation datasets.
CLASSES = ("exact", "partial", "graded", "distractor_heavy", "oov", "no_answer", "length_bias", "repeated_term")
WORDS = ("shard", "planner", "cache", "signature", "manifest", "bucket", "posting", "window", "segment", "vector", "budget", "reclaim")


def _pick(*parts) -> F.Column:
    words = F.array(*[F.lit(w) for w in WORDS])
    return F.element_at(words, (F.pmod(F.xxhash64(*parts), F.lit(len(WORDS))) + 1).cast("int"))


def lexical_dataset(spark: SparkSession, docs: int, queries: int, seed: int = 12) -> dict[str, DataFrame]:
    """corpus, queries and qrels; every query's class and target follow from its number and the seed.

    A document has six words and a key of its own; every fifth one is long, with forty words more. exact asks for all
    words of its target, partial for the key and two of them, graded for the key and its topic, length_bias for the key
    of a long document, repeated_term for the key twice, distractor_heavy for the key among words that many have; oov
    and no_answer have no words of the corpus.
    """
    s = F.lit(seed)
    words = lambda c, n: [_pick(c, F.lit(k), s) for k in range(n)]
    padding = F.when(F.col("id") % 5 == 0, F.concat_ws(" ", *[_pick("id", F.lit(100 + k), s) for k in range(40)]))
    base = F.concat_ws(" ", *words("id", 6), F.concat(F.lit("key"), F.col("id").cast("string")), padding)
    corpus = spark.range(docs).select(F.concat(F.lit("doc-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("item_id"), base.alias("text"), F.create_map(F.lit("topic"), _pick("id", F.lit("topic"), s)).alias("metadata"))
    kind = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("id") % len(CLASSES) + 1).cast("int"))
    target = F.pmod(F.xxhash64("id", s), F.lit(docs))
    own = spark.range(queries).withColumn("query_type", kind).withColumn("target", target)
    own = own.withColumn("target", F.when(F.col("query_type") == "length_bias", F.col("target") - F.col("target") % 5).otherwise(F.col("target")))
    key = F.concat(F.lit("key"), F.col("target").cast("string"))
    text = (
        F.when(F.col("query_type").isin("oov", "no_answer"), F.concat(F.lit("absent"), F.col("id").cast("string")))
        .when(F.col("query_type") == "repeated_term", F.concat_ws(" ", key, key))
        .when(F.col("query_type") == "distractor_heavy", F.concat_ws(" ", F.lit("shard cache bucket"), key))
        .when(F.col("query_type") == "exact", F.concat_ws(" ", *words("target", 6), key))
        .when(F.col("query_type") == "partial", F.concat_ws(" ", *words("target", 2), key))
        .when(F.col("query_type") == "graded", F.concat_ws(" ", key, _pick("target", F.lit("topic"), s)))
        .otherwise(key)
    )
    named = own.select(F.concat(F.lit("q-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("query_id"), text.alias("text"), "query_type", F.when(F.col("query_type").isin("oov", "no_answer"), "NoAnswer").otherwise("JudgedRetrieval").alias("answer_mode"), "target")
    qrels = named.where("answer_mode = 'JudgedRetrieval'").select("query_id", F.concat(F.lit("doc-"), F.lpad(F.col("target").cast("string"), 8, "0")).alias("item_id"), F.when(F.col("query_type") == "graded", 3).otherwise(1).alias("grade"))
    return {"corpus": corpus, "queries": named.drop("target"), "qrels": qrels}


def clustered_vectors(spark: SparkSession, rows: int, width: int, clusters: int = 64, spread: float = 0.28, seed: int = 7) -> DataFrame:
    """(id, embedding, cluster): unit vectors around seeded centers, made in the JVM row by row."""
    centers = np.random.default_rng(seed).normal(size=(clusters, width))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    noise = F.array(*[F.randn(seed + 1 + d) for d in range(width)])
    made = spark.range(rows).withColumn("cluster", (F.col("id") % clusters).cast("int")).withColumn("raw", F.zip_with(table[F.col("cluster")], noise, lambda c, n: c + n * F.lit(spread / width**0.5)))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return made.withColumn("length", length).select("id", F.transform("raw", lambda x: (x / F.col("length")).cast("float")).alias("embedding"), "cluster")


def _unit(raw: F.Column) -> F.Column:
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: (x / length).cast("float"))


def random_vectors(spark: SparkSession, rows: int, width: int, seed: int = 7) -> DataFrame:
    """(id, embedding): unit vectors of independent directions."""
    made = spark.range(rows).withColumn("raw", F.array(*[F.randn(seed + d) for d in range(width)]))
    return made.select("id", _unit(F.col("raw")).alias("embedding"))


def noisy_queries(vectors: DataFrame, width: int, every: int, noise: float = 0.1, seed: int = 99) -> DataFrame:
    """(id, target, embedding): every so many-th vector with noise, turned to length 1; the target is its id."""
    some = vectors.where(F.col("id") % every == 0).withColumn("noise", F.array(*[F.randn(seed + d) for d in range(width)]))
    moved = F.zip_with("embedding", "noise", lambda x, n: x.cast("double") + n * F.lit(noise / width**0.5))
    return some.withColumn("raw", moved).select("id", F.col("id").alias("target"), _unit(F.col("raw")).alias("embedding"))


def stub_dataset(spark: SparkSession) -> dict[str, DataFrame]:
    """The least dataset that evaluates: two items, a judged query, one without an answer, one to be ignored."""
    return {
        "corpus": spark.createDataFrame([("a", "cache shard", {"topic": "cache"}), ("b", "plan", {})], "item_id string, text string, metadata map<string, string>"),
        "queries": spark.createDataFrame([("q1", "cache", "exact", "JudgedRetrieval"), ("q2", "absent", "no_answer", "NoAnswer"), ("q3", "plan", "exact", "Ignore")], "query_id string, text string, query_type string, answer_mode string"),
        "qrels": spark.createDataFrame([("q1", "a", 1)], "query_id string, item_id string, grade int"),
    }


def stub_run(queries: DataFrame, corpus: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(query_id, item_id, rank): a seeded arbitrary list for each query, from k rows of the corpus by hash."""
    some = corpus.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(k)
    pairs = queries.select("query_id").distinct().crossJoin(F.broadcast(some.select("item_id")))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("query_id", "item_id", F.lit(seed)))))
