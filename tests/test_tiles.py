"""Searches in tiles beside their SQL, over tables with repeated and missing ids."""

import pytest

from siltstone.plans import lexical_queries as Q
from tools.compare import difference, tables

#: Queries that ask all documents at once, from their tiles instead of the stored index.
TILED = ["bm25_topk", "bm25_filtered_lang", "bow_cosine_topk", "engine_search", "phrase_search", "bm25_metadata_filters", "bm25f_topk", "keyword_overlap_topk", "bm25_own_parameters", "boolean_search", "context_budget", "near_search"]


#: What is said of a document or query of two rows is left open in these.
ONE_ROW_EACH = ("engine_search", "context_budget")


def write(spark, root, repeated):
    docs = [(n, "the cache\nwas warm the cache was slow", "de", "a") for n in range(1100)] + [(2000 + n, f"cold\nthe cache was {n} and very slow to fill again", "en", "b") for n in range(15)]
    docs += [(3000, "title of the cache\nslow cache was the cache", "en", "a"), (3001, None, "en", "a"), (3002, "?", "en", "a"), (3003, "was", "fr", "a"), (4000, "the slow cache", "en", "a"), *[(4000, "was was the cache slow", "en", "a"), (None, "the cache was", "en", "a")][: 2 * repeated]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(2).write.parquet(f"{root}/documents.parquet")
    chunks = [("a", "the cache was slow", {"topic": "x"}), ("b", "the slow cache", {"topic": "y", "facet": "z"}), ("c", "cache", None), ("d", "the reindex", {}), ("d", "the reindex", {}), (None, "the cache", {}), ("e", None, {"topic": "x"})]
    spark.createDataFrame(chunks, "chunk_id string, text string, metadata map<string,string>").coalesce(1).write.parquet(f"{root}/chunks.parquet")
    x, y, none = [("topic", "x")], [("topic", "y"), ("facet", "z")], []
    asked = [("q-20", "the cache was slow", 5, x), ("q-40", "slow the cache was", 30, y), ("q-40", "slow the cache was", 30, y), ("q-60", "the was slow cache", None, none), ("q-80", "cache the the cache", 0, none), ("q-100", "unheard of", 3, None), ("q-120", None, 3, None), ("q-7", "the slow cache", 3, [("topic", "")])]
    asked += [("q-9", "the slow cache", 3, none), ("q-140", "the cache was slow", 4, y), *[("q-140", "was the cache slow", 4, x)][:repeated], ("q-160", "cold", 10, none)]
    spark.createDataFrame(asked, "query_id string, text string, hit_limit bigint, metadata_filters array<struct<filter_key:string,filter_value:string>>").coalesce(1).write.parquet(f"{root}/search_queries.parquet")
    return root


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return {repeated: write(spark, str(tmp_path_factory.mktemp("odd")), repeated) for repeated in (True, False)}


@pytest.mark.parametrize("name", TILED)
def test_tiled_search_equals_its_sql_without_an_index(spark, odd, monkeypatch, name):
    monkeypatch.setattr(Q, "index", None)  # building it shuffles all postings
    root = odd[name not in ONE_ROW_EACH]
    rows, wrong = difference(spark, tables(root), root, Q.QUERIES[name], Q.SQL[name])
    assert wrong is None and rows


def test_metadata_filters_answer_every_query(spark, odd):
    """Numbers that 20 doesn't divide as well: q-7 and q-9."""
    rows = Q.bm25_metadata_filters(spark, odd[False])
    assert {"q-9", "q-20"} <= {r["query"] for r in rows.collect()}
