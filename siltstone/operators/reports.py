"""Evaluation as a whole: running a retriever over a query set, one report with its checks, lift over chance, mutations."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.evaluation import answer_metrics, latency_stats, mean_metrics, query_metrics
from siltstone.session import stored

#: What a report's quality must have.
CUTOFFS = (1, 5, 10, 50)
FRACTIONS = ("recall_1", "recall_5", "recall_10", "recall_50", "ndcg_10", "mrr", "no_answer_accuracy", "empty_fraction", "oov_fraction")


def run_retriever(retriever: Callable[[DataFrame], DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, item_id, rank, latency_ms): a retriever's hits for all queries but those to be ignored.

    ``retriever`` takes (query_id, text, ...) and gives (query_id, item_id, rank). The queries are one batch, so a
    query's latency is the time of the batch divided by its queries.
    """
    asked = queries.where(F.coalesce("answer_mode", F.lit("JudgedRetrieval")) != "Ignore")
    began = time.time()
    hits = stored(retriever(asked).select("query_id", "item_id", "rank"))
    each = 1000 * (time.time() - began) / max(1, asked.select("query_id").distinct().count())
    return hits.withColumn("latency_ms", F.lit(each))


def metric_rows(means: DataFrame) -> DataFrame:
    """(metric, k, value) from a row of means such as recall_10; metrics without a cutoff have a null k."""
    names = [c for c, t in means.dtypes if t in ("double", "float")]
    parts = [F.struct(F.lit(c.rsplit("_", 1)[0] if c.rsplit("_", 1)[-1].isdigit() else c).alias("metric"), F.lit(int(c.rsplit("_", 1)[1]) if c.rsplit("_", 1)[-1].isdigit() else None).cast("int").alias("k"), F.col(c).cast("double").alias("value")) for c in names]
    return means.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def metric_value_at(rows: DataFrame, metric: str, k: int) -> DataFrame:
    """The one value of a metric at a cutoff."""
    return rows.where((F.col("metric") == metric) & (F.col("k") == k)).select("value")


def evaluate(run: DataFrame, queries: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row: the means over judged queries, the answers by mode, and the latencies where the run has them.

    ``run`` is (query_id, item_id, rank) and may have latency_ms, one value a query.
    """
    modes = queries.select("query_id", F.coalesce("answer_mode", F.lit("JudgedRetrieval")).alias("answer_mode")).distinct()
    counted = run.join(modes.where("answer_mode <> 'Ignore'"), "query_id", "left_semi")
    judged = qrels.join(modes.where("answer_mode = 'JudgedRetrieval'"), "query_id", "left_semi")
    means = mean_metrics(query_metrics(counted.select("query_id", "item_id", "rank"), judged, cutoffs)).drop("judged")
    answers = answer_metrics(modes, counted)
    latency = counted.groupBy("query_id").agg(F.max("latency_ms" if "latency_ms" in run.columns else F.lit(None).cast("double")).alias("latency_ms"))
    times = latency_stats(latency, "latency_ms").select(*[F.col(c).alias(f"latency_{c}") for c in ("count", "mean", "least", "most", "p50", "p95", "p99")])
    one = answers.crossJoin(F.broadcast(means))
    runs = counted.agg(F.countDistinct("query_id").alias("run_queries"))
    return one.crossJoin(F.broadcast(runs)).crossJoin(F.broadcast(times))


def benchmark_report(evaluation: DataFrame, name: str, baseline: str, dataset: str, oov_fraction: float, total_ms: float) -> DataFrame:
    """The row of ``evaluate`` with names, out-of-vocabulary share and queries a second."""
    return evaluation.select(F.lit(1).alias("schema_version"), F.lit(name).alias("benchmark_name"), F.lit(baseline).alias("baseline_name"), F.lit(dataset).alias("dataset_name"), "*", F.lit(float(oov_fraction)).alias("oov_fraction"), F.lit(float(total_ms)).alias("total_ms"), F.when(F.lit(total_ms) > 0, F.col("evaluated") * 1000.0 / F.lit(float(total_ms))).otherwise(0.0).alias("queries_per_second"))


def report_problems(report: DataFrame) -> DataFrame:
    """(problem): what a report must not have: empty names, missing cutoffs, shares outside 0 to 1, latencies that fall from
    one percentile to a higher one or are negative or infinite, or counts that don't agree."""
    missing = [c for c in FRACTIONS if c not in report.columns]
    bad = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1))
    wrong = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf")))
    rules = [(F.lit(True), f"{c} missing") for c in missing]
    rules += [(F.col(c) == "", f"{c} empty") for c in ("benchmark_name", "baseline_name", "dataset_name")]
    rules += [(bad(c), f"{c} not a share") for c in FRACTIONS if c not in missing]
    rules += [(wrong(c), f"{c} not a time") for c in ("latency_mean", "latency_p50", "latency_p95", "latency_p99", "queries_per_second", "total_ms")]
    rules += [(F.col("latency_p95") < F.col("latency_p50"), "latency falls from p50 to p95"), (F.col("latency_p99") < F.col("latency_p95"), "latency falls from p95 to p99")]
    rules += [(F.col("evaluated") != F.col("judged") + F.col("no_answer"), "evaluated queries don't add up"), (F.col("latency_count") != F.col("run_queries"), "runs without latency"), (F.col("schema_version") != 1, "schema version unknown")]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in rules]))
    return report.select(F.explode(found).alias("problem"))


def candidate_lift(coverage: DataFrame, rows: DataFrame, candidates: int) -> DataFrame:
    """One row: mean coverage of the wanted items, what as many random candidates would cover, and the ratio."""
    n = rows.agg(F.count("*").alias("n"))
    mean = coverage.agg(F.avg("coverage").alias("coverage"))
    return mean.crossJoin(F.broadcast(n)).select("coverage", F.least(F.lit(1.0), F.lit(float(candidates)) / F.col("n")).alias("expected")).withColumn("lift", F.col("coverage") / F.col("expected"))


def mutation_sizes(rows: DataFrame, key: str, erased: DataFrame, upserted: DataFrame) -> DataFrame:
    """(step, rows): the distinct keys of a store at first, after some are erased, and after others are put in."""
    start = rows.select(key).distinct()
    left = start.join(erased.select(key).distinct(), key, "left_anti")
    after = left.unionByName(upserted.select(key)).distinct()
    parts = [t.agg(F.lit(n).alias("step"), F.count("*").alias("rows")) for n, t in (("start", start), ("erased", left), ("upserted", after))]
    return reduce(DataFrame.unionByName, parts)
