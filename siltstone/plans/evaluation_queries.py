"""Evaluation queries: metrics of exact search against labels, result lists, latencies, dataset checks, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation as E
from siltstone.operators import ranking as R
from siltstone.operators import reports as P
from siltstone.plans import vector_queries as V
from siltstone.session import load


def _label_qrels(spark, root):
    rows = V.embeddings(spark, root).select(F.col("vec_id").alias("item_id"), "label")
    asked = V.asked(spark, root).select(F.col("vec_id").alias("query_id"), "label")
    return asked.join(rows, "label").where("query_id <> item_id").select("query_id", "item_id", F.lit(1).alias("grade"))


def _label_run(spark, root):
    from siltstone.operators.vectors import exact_top_k

    return exact_top_k(V.embeddings(spark, root), V.asked(spark, root), "vec_id", "embedding", V.WIDTH, "cosine", 50).select(F.col("query").alias("query_id"), F.col("item").alias("item_id"), "rank")


def query_metrics(spark, root):
    made = E.query_metrics(_label_run(spark, root), _label_qrels(spark, root))
    return made.select("query_id", *[F.round(c, 6).alias(c) for c in made.columns if c != "query_id"])


def recall_ndcg_mrr(spark, root):
    made = E.mean_metrics(E.query_metrics(_label_run(spark, root), _label_qrels(spark, root)))
    return made.select("judged", *[F.round(c, 6).alias(c) for c in made.columns if c != "judged"])


def graded_metrics(spark, root):
    """Lexical lists against grades that follow from the signatures' distances."""
    made = E.query_metrics(_lexical_run(spark, root), _graded(spark, root), (5, 10))
    return E.mean_metrics(made).select("judged", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_5", "ndcg_10", "mrr")])


def _graded(spark, root):
    best = load(spark, root, "signature_hits").where("query_id is not null and chunk_id is not null and hamming_distance is not null").groupBy("query_id", "chunk_id").agg(F.min("hamming_distance").alias("d"))
    return best.select("query_id", F.col("chunk_id").alias("item_id"), F.greatest(F.lit(0), 3 - F.floor(F.col("d") / 16)).cast("int").alias("grade"))


def _lexical_run(spark, root):
    return R.ranked_list(load(spark, root, "lexical_hits"), "query_id", "chunk_id", "score", 50).select(F.col("query").alias("query_id"), F.col("item").alias("item_id"), "rank")


def no_answer_metrics(spark, root):
    queries = load(spark, root, "search_queries").select("query_id", "answer_mode").distinct()
    hits = load(spark, root, "lexical_hits").where("query_id is not null and chunk_id is not null and score is not null and not isnan(score)")
    made = E.answer_metrics(queries, hits)
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in made.dtypes])


def latency_percentiles(spark, root):
    made = E.latency_stats(load(spark, root, "events"), "value", "event_type")
    return made.select("event_type", "count", F.round("mean", 6).alias("mean"), *[F.round(c, 6).alias(c) for c in ("least", "most", "p50", "p95", "p99")])


def dataset_problems(spark, root):
    corpus = load(spark, root, "chunks").select(F.col("chunk_id").alias("item_id"))
    queries = load(spark, root, "search_queries")
    found = E.dataset_problems(corpus, queries, _graded(spark, root))
    return found.groupBy("problem").agg(F.count("*").alias("rows"))


def run_problems(spark, root):
    run = load(spark, root, "lexical_hits").where("query_id is not null and score is not null").select("query_id", F.lit(0).alias("rank"), F.col("score").cast("double").alias("score"))
    return E.run_problems(run).groupBy("problem").agg(F.count("*").alias("queries"))


def candidate_coverage(spark, root):
    """Share of each query's ten best lexical chunks that its vector hits have at all."""
    best = R.ranked_list(load(spark, root, "lexical_hits"), "query_id", "chunk_id", "score", 10).select("query", "item")
    hits = load(spark, root, "vector_hits").where("query_id is not null and chunk_id is not null").select(F.col("query_id").alias("query"), F.col("chunk_id").alias("item"))
    return E.coverage(best, hits, 10).select("query", F.round("coverage", 6).alias("coverage"))


def score_statistics(spark, root):
    """Population statistics of each retriever's scores."""
    rows = load(spark, root, "vector_hits").where("score is not null and not isnan(score) and retriever is not null")
    s = F.col("score").cast("double")
    return rows.groupBy("retriever").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("deviation"), F.round(F.min(s), 6).alias("least"), F.round(F.max(s), 6).alias("most"))


def retriever_grid(spark, root):
    """Hits and scores by retriever and hour of the day, with the sums of either."""
    rows = load(spark, root, "vector_hits").where("score is not null and not isnan(score)").select(F.coalesce("retriever", F.lit("?")).alias("retriever"), F.hour("served_at").alias("hour"), F.col("score").cast("double").alias("s"))
    return rows.cube("retriever", "hour").agg(F.count("*").alias("hits"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.expr("percentile_disc(0.95) within group (order by s)"), 6).alias("p95"))


def rrf_fusion(spark, root):
    parts = [(R.ranked_list(load(spark, root, t), "query_id", "chunk_id", c, 50, up), w) for t, c, up, w in (("vector_hits", "score", True, 1.0), ("signature_hits", "hamming_distance", False, 0.5), ("lexical_hits", "score", True, 1.0))]
    fused = R.reciprocal_rank_fusion(parts).withColumn("score", F.round("score", 8))
    from siltstone.operators.lexical import top_k

    return top_k(fused, "query", "item", "score", 10)


def decay_score(spark, root):
    events = load(spark, root, "events").where("user_id is not null and value is not null")
    newest = events.agg(F.max("ts").alias("newest"))
    age = F.unix_timestamp("newest") - F.unix_timestamp("ts")
    part = R.decayed(F.col("value"), age / F.lit(86400.0), 7.0)
    made = events.crossJoin(F.broadcast(newest)).groupBy("user_id").agg(F.sum(part).alias("s"), F.count("*").alias("uses"))
    return made.select("user_id", F.round(F.col("s") + 0.5 * F.log1p("uses"), 4).alias("score"))


def bootstrap_interval(spark, root):
    made = E.query_metrics(_label_run(spark, root), _label_qrels(spark, root))
    return E.paired_bootstrap(made, "ndcg_10", "ndcg_5", 500)


def _timed_run(spark, root):
    """The lexical lists, a query's latency being a tenth of a millisecond per hit."""
    from pyspark.sql import Window

    return _lexical_run(spark, root).withColumn("latency_ms", F.count("*").over(Window.partitionBy("query_id")) / 10.0)


def evaluation_report(spark, root):
    made = P.evaluate(_timed_run(spark, root), load(spark, root, "search_queries"), _graded(spark, root))
    report = P.benchmark_report(made, "lists", "lexical", "hits", 0.0, 2000.0)
    names = ("judged", "no_answer", "ignored", "evaluated", "run_queries", "recall_1", "recall_5", "recall_10", "recall_50", "ndcg_10", "mrr", "no_answer_accuracy", "latency_mean", "latency_p50", "latency_p95", "queries_per_second")
    return report.select(*[F.round(c, 6).alias(c) if dict(report.dtypes)[c] == "double" else c for c in names])


def report_problems(spark, root):
    """Queries without a list make the counts differ, and no out-of-vocabulary share was given within 0 to 1."""
    made = P.evaluate(_timed_run(spark, root), load(spark, root, "search_queries"), _graded(spark, root))
    return P.report_problems(P.benchmark_report(made, "", "lexical", "hits", 1.5, 2000.0))


def metric_values(spark, root):
    """Mean metrics as rows."""
    made = P.metric_rows(E.mean_metrics(E.query_metrics(_lexical_run(spark, root), _graded(spark, root), (5, 10))))
    return made.select("metric", "k", F.round("value", 6).alias("value"))


def candidate_lift(spark, root):
    """How much better than chance 100 signatures cover the exact ten."""
    one = P.candidate_lift(V.hamming_rerank_coverage(spark, root), V.embeddings(spark, root), 100)
    return one.select(*[F.round(c, 4).alias(c) for c in one.columns])


def mutation_sizes(spark, root):
    """Chunks of vector records: those of documents divisible by 3 erased, those of lexical records put in."""
    rows = load(spark, root, "vector_records").where("chunk_id is not null").select("chunk_id")
    gone = load(spark, root, "chunks").where("doc_id % 3 = 0").select("chunk_id")
    return P.mutation_sizes(rows, "chunk_id", gone, load(spark, root, "lexical_records").where("chunk_id is not null").select("chunk_id"))


QUERIES = {f.__name__: f for f in (query_metrics, recall_ndcg_mrr, graded_metrics, no_answer_metrics, latency_percentiles, dataset_problems, run_problems, candidate_coverage, score_statistics, retriever_grid, rrf_fusion, decay_score, bootstrap_interval, evaluation_report, report_problems, metric_values, candidate_lift, mutation_sizes)}

LABELS = V._top(V.COSINE) + """, run AS (SELECT query AS query_id, item AS item_id, rank FROM r WHERE rank <= 50),
qrels AS (SELECT a.id AS query_id, b.id AS item_id, 1 AS grade FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id % 20 = 0)"""


def _metrics(cutoffs: tuple[int, ...]) -> str:
    recall = ", ".join(f"coalesce(count(*) FILTER (rank <= {k}) / any_value(n), 0) AS recall_{k}" for k in cutoffs)
    ndcg = ", ".join(f"coalesce(sum((2.0 ** grade - 1) / log2(rank + 1)) FILTER (rank <= {k}) / sum((2.0 ** grade - 1) / log2(place + 1)) FILTER (place <= {k}), 0) AS ndcg_{k}" for k in cutoffs)
    return f""", ju AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM qrels WHERE grade > 0),
pq AS (SELECT ju.query_id, {recall}, {ndcg}, coalesce(1 / min(rank), 0) AS reciprocal_rank FROM ju LEFT JOIN run ON run.query_id = ju.query_id AND run.item_id = ju.item_id GROUP BY 1)"""


def _means(cutoffs: tuple[int, ...]) -> str:
    return " SELECT count(*) AS judged, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for m in ("recall", "ndcg") for k in cutoffs) + ", round(avg(reciprocal_rank), 6) AS mrr FROM pq"


ALL = (1, 5, 10, 50)
VALID = "query_id IS NOT NULL AND chunk_id IS NOT NULL AND {0} IS NOT NULL AND NOT isnan({0}::DOUBLE)"


def _list(table: str, value: str, k: int, higher: bool = True) -> str:
    return f"(SELECT * FROM (SELECT query_id AS query, chunk_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY v {'DESC' if higher else 'ASC'}, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {'max' if higher else 'min'}({value}) AS v FROM {table} WHERE {VALID.format(value)} GROUP BY ALL)) WHERE rank <= {k})"


GRADED = "qrels AS (SELECT query_id, chunk_id AS item_id, greatest(0, 3 - floor(min(hamming_distance) / 16))::INT AS grade FROM signature_hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND hamming_distance IS NOT NULL GROUP BY ALL)"

MODES = "qm AS (SELECT DISTINCT query_id, coalesce(answer_mode, 'JudgedRetrieval') AS mode FROM search_queries WHERE query_id IS NOT NULL)"
REPORT = f"""WITH {GRADED.replace("qrels AS", "allq AS")}, {MODES},
qrels AS (SELECT allq.* FROM allq WHERE query_id IN (SELECT query_id FROM qm WHERE mode = 'JudgedRetrieval')),
run AS (SELECT query AS query_id, item AS item_id, rank FROM {_list("lexical_hits", "score", 50)} WHERE query IN (SELECT query_id FROM qm WHERE mode <> 'Ignore'))""" + _metrics(ALL) + """,
la AS (SELECT query_id, count(*) / 10.0::DOUBLE AS ms FROM run GROUP BY 1), me AS (SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_50), 6) AS recall_50, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(reciprocal_rank), 6) AS mrr FROM pq),
an AS (SELECT count(*) FILTER (mode = 'JudgedRetrieval') AS judged, count(*) FILTER (mode = 'NoAnswer') AS no_answer, count(*) FILTER (mode = 'Ignore') AS ignored, count(*) FILTER (mode <> 'Ignore') AS evaluated, round(count(*) FILTER (mode = 'NoAnswer' AND la.query_id IS NULL) / count(*) FILTER (mode = 'NoAnswer'), 6) AS no_answer_accuracy FROM qm LEFT JOIN la USING (query_id)),
ti AS (SELECT count(*) AS run_queries, round(avg(ms), 6) AS latency_mean, quantile_disc(ms, 0.5) AS latency_p50, quantile_disc(ms, 0.95) AS latency_p95 FROM la)
"""

SQL = {
    "evaluation_report": REPORT + "SELECT judged, no_answer, ignored, evaluated, run_queries, me.*, no_answer_accuracy, latency_mean, latency_p50, latency_p95, round(evaluated / 2.0, 6) AS queries_per_second FROM an, me, ti",
    "report_problems": "SELECT unnest(['benchmark_name empty', 'oov_fraction not a share']) AS problem",
    "metric_values": f"WITH {GRADED}, run AS (SELECT query AS query_id, item AS item_id, rank FROM {_list('lexical_hits', 'score', 50)})" + _metrics((5, 10)) + ", m AS (SELECT avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, avg(ndcg_5) AS ndcg_5, avg(ndcg_10) AS ndcg_10, avg(reciprocal_rank) AS mrr FROM pq) SELECT unnest(['recall', 'recall', 'ndcg', 'ndcg', 'mrr']) AS metric, unnest([5, 10, 5, 10, NULL])::INT AS k, round(unnest([recall_5, recall_10, ndcg_5, ndcg_10, mrr]), 6) AS value FROM m",
    "candidate_lift": "WITH cv AS (" + V.SQL["hamming_rerank_coverage"] + "), n AS (SELECT count(*) AS n FROM embeddings) SELECT round(avg(coverage), 4) AS coverage, round(100 / any_value(n), 4) AS expected, round(avg(coverage) / (100 / any_value(n)), 4) AS lift FROM cv, n",
    "mutation_sizes": """WITH s AS (SELECT DISTINCT chunk_id FROM vector_records WHERE chunk_id IS NOT NULL), l AS (SELECT chunk_id FROM s WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE doc_id % 3 = 0 AND chunk_id IS NOT NULL)),
u AS (SELECT chunk_id FROM l UNION SELECT chunk_id FROM lexical_records WHERE chunk_id IS NOT NULL) SELECT 'start' AS step, count(*) AS rows FROM s UNION ALL SELECT 'erased', count(*) FROM l UNION ALL SELECT 'upserted', count(*) FROM u""",
    "query_metrics": LABELS + _metrics(ALL) + " SELECT query_id, " + ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for m in ("recall", "ndcg") for k in ALL) + ", round(reciprocal_rank, 6) AS reciprocal_rank FROM pq",
    "recall_ndcg_mrr": LABELS + _metrics(ALL) + _means(ALL),
    "graded_metrics": f"WITH {GRADED}, run AS (SELECT query AS query_id, item AS item_id, rank FROM {_list('lexical_hits', 'score', 50)})" + _metrics((5, 10)) + _means((5, 10)),
    "no_answer_metrics": f"""WITH q AS (SELECT DISTINCT query_id, coalesce(answer_mode, 'JudgedRetrieval') AS mode FROM search_queries),
h AS (SELECT DISTINCT query_id FROM lexical_hits WHERE {VALID.format("score")}),
x AS (SELECT q.*, h.query_id IS NULL AS empty FROM q LEFT JOIN h USING (query_id))
SELECT count(*) AS query_count, count(*) FILTER (mode = 'JudgedRetrieval') AS judged, count(*) FILTER (mode = 'NoAnswer') AS no_answer, count(*) FILTER (mode = 'Ignore') AS ignored, count(*) FILTER (mode <> 'Ignore') AS evaluated,
  round(count(*) FILTER (mode = 'NoAnswer' AND empty) / count(*) FILTER (mode = 'NoAnswer'), 6) AS no_answer_accuracy, count(*) FILTER (mode <> 'Ignore' AND empty) AS empty_count, round(count(*) FILTER (mode <> 'Ignore' AND empty) / count(*) FILTER (mode <> 'Ignore'), 6) AS empty_fraction FROM x""",
    "latency_percentiles": "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "dataset_problems": f"""WITH {GRADED}, q AS (SELECT DISTINCT query_id, coalesce(answer_mode, 'JudgedRetrieval') AS mode FROM search_queries),
p AS (SELECT 'item repeated' AS problem FROM chunks GROUP BY chunk_id HAVING chunk_id IS NULL OR count(*) > 1
UNION ALL SELECT 'query repeated' FROM search_queries GROUP BY query_id HAVING query_id IS NULL OR count(*) > 1
UNION ALL SELECT 'judgment without query' FROM qrels WHERE query_id NOT IN (SELECT query_id FROM search_queries)
UNION ALL SELECT 'judgment without item' FROM qrels WHERE item_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)
UNION ALL SELECT 'judged query without positive' FROM q WHERE mode = 'JudgedRetrieval' AND query_id NOT IN (SELECT query_id FROM qrels WHERE grade > 0)
UNION ALL SELECT 'no-answer query with positive' FROM q WHERE mode = 'NoAnswer' AND query_id IN (SELECT query_id FROM qrels WHERE grade > 0))
SELECT problem, count(*) AS rows FROM p GROUP BY 1""",
    "run_problems": "SELECT 'score not finite' AS problem, count(*) AS queries FROM (SELECT query_id FROM lexical_hits WHERE query_id IS NOT NULL AND score IS NOT NULL GROUP BY 1 HAVING bool_or(NOT isfinite(score))) HAVING count(*) > 0",
    "candidate_coverage": f"WITH b AS {_list('lexical_hits', 'score', 10)}, h AS (SELECT DISTINCT query_id AS query, chunk_id AS item FROM vector_hits) SELECT b.query, round(count(h.item) / 10, 6) AS coverage FROM b LEFT JOIN h ON h.query = b.query AND h.item = b.item GROUP BY 1",
    "score_statistics": "SELECT retriever, count(*) AS n, round(avg(score::DOUBLE), 6) AS mean, round(stddev_pop(score::DOUBLE), 6) AS deviation, round(min(score::DOUBLE), 6) AS least, round(max(score::DOUBLE), 6) AS most FROM vector_hits WHERE score IS NOT NULL AND NOT isnan(score) AND retriever IS NOT NULL GROUP BY 1",
    "retriever_grid": "SELECT retriever, hour, count(*) AS hits, round(avg(s), 6) AS mean, round(quantile_disc(s, 0.95), 6) AS p95 FROM (SELECT coalesce(retriever, '?') AS retriever, hour(served_at AT TIME ZONE 'UTC')::INT AS hour, score::DOUBLE AS s FROM vector_hits WHERE score IS NOT NULL AND NOT isnan(score)) GROUP BY CUBE (retriever, hour)",
    "rrf_fusion": f"""WITH u AS (SELECT query, item, 1.0::DOUBLE / (60 + rank) AS p FROM {_list("vector_hits", "score", 50)} UNION ALL SELECT query, item, 0.5::DOUBLE / (60 + rank) FROM {_list("signature_hits", "hamming_distance", 50, False)} UNION ALL SELECT query, item, 1.0::DOUBLE / (60 + rank) FROM {_list("lexical_hits", "score", 50)}),
s AS (SELECT query, item, round(sum(p), 8) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "decay_score": "SELECT user_id, round(sum(value * exp(-((epoch((SELECT max(ts) FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL))::BIGINT - floor(epoch(ts))::BIGINT) / 86400.0::DOUBLE) / 7)) + 0.5 * ln(1 + count(*)), 4) AS score FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1",
}
