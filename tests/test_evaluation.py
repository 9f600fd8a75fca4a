import math

from siltstone.operators import evaluation as E


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "a", 3), ("q1", "b", 1), ("q2", "c", 1), ("q3", "d", 0)], "query_id string, item_id string, grade int")
    run = spark.createDataFrame([("q1", "x", 1), ("q1", "a", 2), ("q1", "a", 3), ("q1", "b", 4)], "query_id string, item_id string, rank int")
    rows = {r["query_id"]: r for r in E.query_metrics(run, qrels, (1, 5)).collect()}
    assert set(rows) == {"q1", "q2"}
    assert rows["q1"]["recall_1"] == 0 and rows["q1"]["recall_5"] == 1 and rows["q1"]["reciprocal_rank"] == 0.5
    assert math.isclose(rows["q1"]["ndcg_5"], (7 / math.log2(3) + 1 / math.log2(5)) / (7 + 1 / math.log2(3)))
    assert rows["q2"]["ndcg_5"] == 0 and rows["q2"]["reciprocal_rank"] == 0


def test_latency_is_nearest_rank(spark):
    r = E.latency_stats(spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,), (None,)], "v double"), "v").first()
    assert (r["count"], r["mean"], r["p50"], r["p95"]) == (4, 25.0, 20.0, 40.0)


def test_missing_runs_are_empty(spark):
    queries = spark.createDataFrame([("a", "JudgedRetrieval"), ("b", "NoAnswer"), ("c", "NoAnswer"), ("d", "Ignore"), ("e", None)], "query_id string, answer_mode string")
    run = spark.createDataFrame([("a",), ("b",)], "query_id string")
    r = E.answer_metrics(queries, run).first()
    assert (r["query_count"], r["judged"], r["ignored"], r["no_answer_accuracy"], r["empty_count"], r["empty_fraction"]) == (5, 2, 1, 0.5, 2, 0.5)


def test_dataset_and_run_problems(spark):
    corpus = spark.createDataFrame([("a",), ("a",)], "item_id string")
    queries = spark.createDataFrame([("q", "JudgedRetrieval"), ("n", "NoAnswer")], "query_id string, answer_mode string")
    qrels = spark.createDataFrame([("q", "z", -1), ("n", "a", 1), ("m", "a", 1)], "query_id string, item_id string, grade int")
    found = {r["problem"] for r in E.dataset_problems(corpus, queries, qrels).collect()}
    assert found == {"item repeated", "judgment without query", "judgment without item", "negative grade", "judged query without positive", "no-answer query with positive"}
    run = spark.createDataFrame([("q", 1, 0.5), ("q", 0, float("inf"))], "query_id string, rank int, score double")
    assert {r["problem"] for r in E.run_problems(run).collect()} == {"mixed ranks", "score not finite"}


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([(f"q{i}", float(i % 7), float(i % 3)) for i in range(200)], "query_id string, a double, b double")
    r = E.paired_bootstrap(rows, "a", "b", 200).first()
    assert r["low"] < r["mean"] < r["high"]
