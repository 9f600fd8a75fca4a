import math

from pyspark.sql import functions as F

from siltstone.functions.text import bow_tokens
from siltstone.operators import lexical as L
from siltstone.operators import ranking as R

DOCS = [("a", "shard cache cache"), ("b", "shard plan"), ("c", "plan plan plan cache"), ("d", None), ("e", "")]


def made(spark):
    docs = spark.createDataFrame(DOCS, "doc string, text string")
    return L.term_counts(docs, "doc", bow_tokens(F.col("text"))), L.document_stats(docs, "doc", bow_tokens(F.col("text")))


def test_bm25_counts_repeated_terms(spark):
    counts, stats = made(spark)
    once = {r["doc"]: r["score"] for r in L.bm25(counts, stats, spark.createDataFrame([("q", "cache")], "query string, term string")).collect()}
    twice = {r["doc"]: r["score"] for r in L.bm25(counts, stats, spark.createDataFrame([("q", "cache")] * 2, "query string, term string")).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3))
    assert math.isclose(once["a"], want) and set(once) == {"a", "c"}
    assert math.isclose(twice["a"], 2 * want)


def test_filters_leave_statistics_alone(spark):
    counts, stats = made(spark)
    q = spark.createDataFrame([("q", "cache")], "query string, term string")
    allowed = spark.createDataFrame([("c",)], "doc string")
    all_ = {r["doc"]: r["score"] for r in L.bm25(counts, stats, q).collect()}
    some = {r["doc"]: r["score"] for r in L.bm25(counts, stats, q, allowed).collect()}
    assert some == {"c": all_["c"]}


def test_overlap_counts_terms_once(spark):
    counts, _ = made(spark)
    q = spark.createDataFrame([("q", "cache"), ("q", "cache"), ("q", "plan")], "query string, term string")
    assert {r["doc"]: r["score"] for r in L.keyword_overlap(counts, q).collect()} == {"a": 1, "b": 1, "c": 2}


def test_bow_top_fills_with_zero_scores(spark):
    counts, stats = made(spark)
    q = spark.createDataFrame([("q", "shard", 1)], "query string, term string, tf long")
    rows = L.bow_cosine_top(counts, q, stats.select("doc"), 3).orderBy("rank").collect()
    assert [r["doc"] for r in rows] == ["b", "a", "c"] and rows[2]["score"] == 0


def test_ids_break_ties_by_bytes(spark):
    rows = spark.createDataFrame([("q", "9", 1.0), ("q", "10", 1.0)], "query string, item string, score double")
    assert [r["item"] for r in L.top_k(rows, "query", "item", "score", 2).orderBy("rank").collect()] == ["10", "9"]


def test_phrases_and_windows(spark):
    docs = spark.createDataFrame(DOCS, "doc string, text string")
    rows = L.term_rows(docs, "doc", bow_tokens(F.col("text")))
    q = spark.createDataFrame([("q", 0, "shard"), ("q", 1, "cache")], "query string, place int, term string")
    assert [tuple(r) for r in L.phrase_matches(rows, q).collect()] == [("q", "a", 1)]
    windows = R.token_windows(docs, "doc", bow_tokens(F.col("text")), 2, 1).where("doc = 'c'").orderBy("window").collect()
    assert [r["tokens"] for r in windows] == [["plan", "plan"], ["plan", "plan"], ["plan", "cache"]]


def test_dictionary_numbers_terms_in_order(spark):
    counts, _ = made(spark)
    assert [(r["term"], r["token_id"], r["df"]) for r in L.dictionary(counts).orderBy("token_id").collect()] == [("cache", 1, 2), ("plan", 2, 2), ("shard", 3, 2)]


def test_fuzzy_finds_all_within_distance(spark):
    v = spark.createDataFrame([("signature",), ("signatur",), ("signatures",), ("sgnaturee",), ("x" * 5000,)], "term string")
    q = spark.createDataFrame([("signature",)], "term string")
    assert {r["term"] for r in R.fuzzy_terms(v, q, 2).collect()} == {"signature", "signatur", "signatures", "sgnaturee"}


def test_index_is_kept_up_without_rebuilding(spark, tmp_path):
    from siltstone.operators.index import LexicalIndex

    def rows(texts):
        docs = spark.createDataFrame(list(texts.items()), "doc string, text string")
        return L.term_rows(docs, "doc", bow_tokens(F.col("text")))

    old = {"a": "cache shard cache", "b": "plan cache", "c": "plan plan", "d": ""}
    new = {"b": "shard only", "e": "cache new"}
    own = LexicalIndex.build(rows(old))
    own.save(f"{tmp_path}/i")
    changed = LexicalIndex.open(spark, f"{tmp_path}/i").updated(rows(new), spark.createDataFrame([("c",), ("never",)], "doc string"))
    whole = LexicalIndex.build(rows({"a": old["a"], **new}))
    for name in ("postings", "lengths", "terms"):
        a, b = getattr(changed, name), getattr(whole, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name
    q = spark.createDataFrame([("q", "cache"), ("q", "shard")], "query string, term string")
    assert sorted(map(tuple, changed.search(q).collect())) == sorted(map(tuple, whole.search(q).collect()))


def test_near_needs_one_chain(spark):
    docs = spark.createDataFrame([("apart", "aa bb x x x x x x x x bb cc"), ("chain", "aa x bb x x cc aa bb cc"), ("late", "aa x x x x bb cc")], "doc string, text string")
    rows = L.term_rows(docs, "doc", bow_tokens(F.regexp_replace("text", "x", "xx")))
    q = spark.createDataFrame([("q", 0, "aa"), ("q", 1, "bb"), ("q", 2, "cc"), ("one", 0, "bb")], "query string, place int, term string")
    got = {(r["query"], r["doc"]): r["hits"] for r in L.phrase_matches(rows, q, 3).collect()}
    assert got == {("q", "chain"): 2, ("one", "apart"): 2, ("one", "chain"): 2, ("one", "late"): 1}
