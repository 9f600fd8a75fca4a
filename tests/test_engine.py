import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.filters import predicate
from siltstone.functions.names import has_embedding, name_or_default, parsed_name, passthrough_enrichment
from siltstone.functions.text import bow_tokens
from siltstone.operators import engine as N
from siltstone.operators import reports as P
from siltstone.operators import similarity as X
from siltstone.operators.lexical import term_rows
from siltstone.operators.index import LexicalIndex
from siltstone.operators.signatures import random_hyperplanes


def test_filters(spark):
    df = spark.createDataFrame([(1, "en", {"k": "v"}, ["t"]), (2, None, {}, None), (3, "de", None, ["u"])], "n int, lang string, m map<string, string>, tags array<string>")
    fits = lambda spec: [r["n"] for r in df.where(predicate(spec)).orderBy("n").collect()]
    assert fits(("eq", "m:k", "v")) == [1] and fits(("not", ("eq", "lang", "en"))) == [2, 3]
    assert fits(("range", "n", 2, None)) == [2, 3] and fits(("range", "lang", None, "df")) == [3]
    assert fits(("tag", "tags", "t")) == [1] and fits(("in", "n", [])) == [] and fits(("starts_with", "lang", "d")) == [3]
    assert fits(("all_of", [])) == [1, 2, 3] and fits(("any_of", [])) == []
    with pytest.raises(ValueError):
        predicate(("like", "n", 1))


def test_names(spark):
    df = spark.createDataFrame([("ChAt", [1.0]), ("none", []), (None, None)], "k string, v array<double>")
    assert [tuple(r) for r in df.select(parsed_name("source_kind", F.col("k")), name_or_default("source_kind", F.col("k")), has_embedding(F.col("v"))).collect()] == [("chat", "chat", True), (None, "unknown", False), (None, "unknown", False)]
    assert passthrough_enrichment(df.withColumn("text", F.lit("x"))).first()["enriched_text"] == "x"


def test_signatures_of_two_encoders_are_not_compared(spark):
    a, b = random_hyperplanes(64, 4, 1), random_hyperplanes(64, 4, 2)
    assert N.fingerprint(a) != N.fingerprint(b) and N.fingerprint(a) == N.fingerprint(random_hyperplanes(64, 4, 1))
    df = spark.createDataFrame([(1, [1.0, 2.0, -1.0, 0.5])], "id long, v array<float>")
    one, two = (N.with_info(e.encode(df, "id", "v"), N.signature_info(e, "m")) for e in (a, b))
    assert N.compatible(one, one)[0].count() == 1
    with pytest.raises(Exception, match="different encoders"):
        N.compatible(one, two)[0].collect()
    with pytest.raises(ValueError):
        N.SignatureInfo("", "f", 4, 64, "m")


def test_registry():
    own = N.EncoderRegistry()
    own.register(random_hyperplanes(64, 4))
    assert own.find("none") is None and own.require("hyperplane").name == "hyperplane"
    with pytest.raises(ValueError):
        own.register(random_hyperplanes(64, 4))
    with pytest.raises(KeyError):
        own.require("none")


def test_engine_parts_are_exchangeable(spark):
    docs = spark.createDataFrame([("a", "cache shard"), ("b", "cache"), ("c", "")], "doc string, text string")
    index = LexicalIndex.build(term_rows(docs, "doc", bow_tokens(F.col("text"))))
    queries = spark.createDataFrame([("q", "cache", 1), ("r", "cache shard", None), ("s", "absent", 5)], "query string, text string, hit_limit long")

    class Backwards:
        def rerank(self, hits, queries):
            return hits.withColumn("score", -F.col("score"))

    plain = N.RetrievalEngine(N.IndexRetriever(index)).search(queries)
    assert [(r["query"], r["doc"]) for r in plain.orderBy("query", "rank").collect()] == [("q", "b"), ("r", "a"), ("r", "b")]
    turned = N.RetrievalEngine(N.IndexRetriever(index), Backwards()).search(queries)
    assert [(r["query"], r["doc"]) for r in turned.orderBy("query", "rank").collect()] == [("q", "a"), ("r", "b"), ("r", "a")]
    none = N.RetrievalEngine(N.IndexRetriever(index), allowed=lambda h: h.where("doc = 'a'")).search(queries)
    assert {r["doc"] for r in none.collect()} == {"a"}
    run = P.run_retriever(lambda q: N.RetrievalEngine(N.IndexRetriever(index)).search(q.withColumnRenamed("query_id", "query")).select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), "rank"), queries.withColumnRenamed("query", "query_id").withColumn("answer_mode", F.when(F.col("query_id") == "q", "Ignore")))
    assert {r["query_id"] for r in run.collect()} == {"r"} and run.first()["latency_ms"] > 0


def test_vector_records_of_chunks(spark):
    chunks = spark.createDataFrame([("a", "x1 x1 yy"), ("a", "x1 x1 yy"), ("b", ""), (None, "zz"), ("c", None)], "chunk_id string, text string")
    made = N.vector_records(chunks, N.HashEmbedder(8)).collect()
    assert [r["chunk_id"] for r in made] == ["a"] and len(made[0]["embedding"]) == 8 and sum(map(abs, made[0]["embedding"])) in (1.0, 3.0)


def test_reports_say_what_is_wrong(spark):
    run = spark.createDataFrame([("q1", "a", 1, 4.0), ("q1", "b", 2, 4.0), ("x", "a", 1, 1.0)], "query_id string, item_id string, rank int, latency_ms double")
    queries = spark.createDataFrame([("q1", None), ("n", "NoAnswer"), ("x", "Ignore")], "query_id string, answer_mode string")
    qrels = spark.createDataFrame([("q1", "b", 1)], "query_id string, item_id string, grade int")
    made = P.evaluate(run, queries, qrels)
    one = made.first()
    assert one["recall_1"] == 0 and one["mrr"] == 0.5 and one["evaluated"] == 2 and one["no_answer_accuracy"] == 1 and one["latency_p50"] == 4
    report = P.benchmark_report(made, "b", "base", "d", 0.1, 100.0)
    assert report.first()["queries_per_second"] == 20 and P.report_problems(report).count() == 0
    bad = report.withColumn("mrr", F.lit(float("nan"))).withColumn("latency_p95", F.lit(1.0)).drop("recall_5").withColumn("dataset_name", F.lit(""))
    assert {r["problem"] for r in P.report_problems(bad).collect()} == {"mrr not a share", "latency falls from p50 to p95", "recall_5 missing", "dataset_name empty"}


def test_similar_sets(spark):
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(60)]
    rows = [(i, list(rng.permutation(base[: 60 - i]))) for i in range(12)] + [(50, base[:55]), (51, base[:55] * 2), (60, [f"u{k}" for k in range(30)]), (61, []), (62, None), (63, [None])]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    queries = spark.createDataFrame([(0,), (51,), (61,)], "id long")
    got = {(r["query"], r["item"]): round(r["overlap"], 6) for r in X.minhash_search(df, queries, "id", "terms").collect()}
    sets = {i: set(t) for i, t in rows if t and t != [None]}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(q, i): round(len(sets[q] & sets[i]) / len(sets[q] | sets[i]), 6) for q in {rep[0], rep[51]} for i in set(rep.values()) if i != q and len(sets[q] & sets[i]) / len(sets[q] | sets[i]) >= 0.8}
    assert got == want and {r["item"]: r["representative"] for r in X.set_classes(df, "id", "terms").collect()} == rep


def test_fields_have_their_own_lengths(spark):
    fields = spark.createDataFrame([("a", "title", "x", 1), ("b", "body", "x", 1), ("b", "title", "y", 1), ("c", "body", "y", 3)], "doc string, field string, term string, tf int")
    q = spark.createDataFrame([("q", "x")], "query string, term string")
    got = {r["doc"]: r["score"] for r in X.bm25f(fields, q).collect()}
    assert set(got) == {"a", "b"} and got["a"] > got["b"]
    assert X.bm25f(fields.limit(0), q).count() == 0
