"""Retrieval evaluation: ranking metrics, latency, coverage, dataset checks and bootstrap intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_run(run: DataFrame) -> DataFrame:
    """Ranks of hits: rank 0 throughout a query means list position by score, given ranks sort by rank and item."""
    given = F.max("rank").over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.when(given > 0, F.col("rank")), F.when(given == 0, -F.col("score")), "item_id")
    return run.withColumn("rank", F.row_number().over(w))


def run_problems(run: DataFrame) -> DataFrame:
    """(query_id, problem): mixed or repeated ranks and scores that aren't finite."""
    bad = run.groupBy("query_id").agg(F.max(F.when(F.col("rank") > 0, 1).otherwise(0)).alias("some"), F.min(F.when(F.col("rank") > 0, 1).otherwise(0)).alias("every"), F.count(F.when(F.col("rank") > 0, 1)).alias("ranks"), F.countDistinct(F.when(F.col("rank") > 0, F.col("rank"))).alias("distinct"), F.max((F.isnan("score") | (F.abs("score") == float("inf"))).cast("int")).alias("infinite"))
    problems = F.array_compact(F.array(F.when(F.col("some") != F.col("every"), "mixed ranks"), F.when(F.col("ranks") > F.col("distinct"), "repeated rank"), F.when(F.col("infinite") == 1, "score not finite")))
    return bad.select("query_id", F.explode(problems).alias("problem"))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def query_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """(query_id, recall_k, ndcg_k, reciprocal_rank) of every query with a positive grade; a missing run counts as 0.

    ``run`` is (query_id, item_id, rank), an item counting once at its first rank; ``qrels`` (query_id, item_id, grade).
    """
    judged = qrels.where("grade > 0")
    first = run.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    ideal = judged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("positives"), *[F.sum(F.when(F.col("place") <= k, gain(F.col("grade")) * discount(F.col("place")))).alias(f"ideal_{k}") for k in cutoffs])
    hits = judged.join(first, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("long")).alias(f"hits_{k}") for k in cutoffs], *[F.sum(F.when(F.col("rank") <= k, gain(F.col("grade")) * discount(F.col("rank")))).alias(f"dcg_{k}") for k in cutoffs])
    both = best.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", *[zero(F.col(f"hits_{k}") / F.col("positives")).alias(f"recall_{k}") for k in cutoffs], *[zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in cutoffs], zero(1 / F.col("first")).alias("reciprocal_rank"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row of means over the judged queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count("*").alias("judged"), *[F.avg(c).alias("mrr" if c == "reciprocal_rank" else c) for c in names])


def answer_metrics(queries: DataFrame, run: DataFrame) -> DataFrame:
    """One row: queries by answer mode, accuracy of the no-answer ones (an empty result is right), empty results."""
    hits = run.groupBy("query_id").agg(F.count("*").alias("hits"))
    all_ = queries.select("query_id", F.coalesce("answer_mode", F.lit("JudgedRetrieval")).alias("mode")).join(hits, "query_id", "left").withColumn("empty", F.col("hits").isNull())
    evaluated = F.col("mode") != "Ignore"
    none = F.col("mode") == "NoAnswer"
    count = lambda c: F.sum(c.cast("long"))
    return all_.agg(F.count("*").alias("query_count"), count(F.col("mode") == "JudgedRetrieval").alias("judged"), count(none).alias("no_answer"), count(~evaluated).alias("ignored"), count(evaluated).alias("evaluated"), (count(none & F.col("empty")) / count(none)).alias("no_answer_accuracy"), count(evaluated & F.col("empty")).alias("empty_count"), (count(evaluated & F.col("empty")) / count(evaluated)).alias("empty_fraction"))


def latency_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, least, most and the nearest-rank 50th, 95th and 99th percentiles, by key."""
    quantiles = [F.expr(f"percentile_disc({q}) within group (order by {value})").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *quantiles)


def coverage(wanted: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query, coverage): share of each query's k wanted items that are among its candidates."""
    found = wanted.join(candidates.select("query", "item").distinct(), ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("found"))
    return wanted.select("query").distinct().join(found, "query", "left").select("query", (F.coalesce("found", F.lit(0)) / k).alias("coverage"))


def dataset_problems(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(problem, id): repeated or null ids, judgments without query or item, negative grades, and queries whose
    judgments contradict their answer mode."""

    def repeated(df: DataFrame, column: str, what: str) -> DataFrame:
        return df.groupBy(column).count().where(F.col(column).isNull() | (F.col("count") > 1)).select(F.lit(what).alias("problem"), F.col(column).cast("string").alias("id"))

    positive = qrels.where("grade > 0").select("query_id").distinct()
    modes = queries.select("query_id", F.coalesce("answer_mode", F.lit("JudgedRetrieval")).alias("mode")).distinct()
    parts = [
        repeated(corpus, "item_id", "item repeated"),
        repeated(queries, "query_id", "query repeated"),
        repeated(qrels.select(F.concat_ws("/", "query_id", "item_id").alias("pair")), "pair", "judgment repeated"),
        qrels.join(queries, "query_id", "left_anti").select(F.lit("judgment without query"), F.col("query_id").cast("string")),
        qrels.join(corpus, "item_id", "left_anti").select(F.lit("judgment without item"), F.col("item_id").cast("string")),
        qrels.where("grade < 0").select(F.lit("negative grade"), F.concat_ws("/", "query_id", "item_id")),
        modes.where("mode = 'JudgedRetrieval'").join(positive, "query_id", "left_anti").select(F.lit("judged query without positive"), "query_id"),
        modes.where("mode = 'NoAnswer'").join(positive, "query_id", "left_semi").select(F.lit("no-answer query with positive"), "query_id"),
    ]
    return reduce(DataFrame.union, parts)


def paired_bootstrap(per_query: DataFrame, a: str, b: str, repeats: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean of a - b and its 2.5 and 97.5 percentiles over resampled queries.

    Each query is drawn a Poisson(1) number of times in each repeat, by a hash of query, repeat and seed: a row's
    weights need no other row, so the resampling is one pass and the sums are ``repeats`` numbers.
    """
    import math

    steps, p = [], math.exp(-1)
    total = 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    u = F.pmod(F.xxhash64("query_id", "repeat", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    weight = reduce(lambda x, y: x + y, [(u >= s).cast("double") for s in steps])
    rows = per_query.select("query_id", (F.col(a) - F.col(b)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn("w", weight)
    means = rows.groupBy("repeat").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return per_query.agg(F.avg(F.col(a) - F.col(b)).alias("mean")).crossJoin(F.broadcast(ends))
