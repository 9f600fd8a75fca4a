"""Lexical index and ranking: postings, corpus statistics, BM25, keyword overlap and bag-of-words cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut, parallelism

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, query: str, item: str, score: str, k: Column | int) -> DataFrame:
    """The best k items of each query by score, then item; k may be a column. Adds ``rank``.

    Spark limits each task's rows before the shuffle when k is a number (WindowGroupLimit).
    """
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))))
    return ranked.where(F.col("rank") <= k)


def term_rows(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, tf, positions): one row per document and distinct term, positions from 0 in order."""
    spread = docs.select(F.col(doc).alias("doc"), F.posexplode(tokens).alias("position", "term"))
    return spread.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def term_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, tf) without positions, which aggregates in fixed-width buffers."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_stats(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token_count, unique_count) of documents that have tokens."""
    return docs.select(F.col(doc).alias("doc"), tokens.alias("t")).where(F.size("t") > 0).select("doc", F.size("t").cast("long").alias("token_count"), F.size(F.array_distinct("t")).cast("long").alias("unique_count"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: documents with tokens, their tokens, the mean length."""
    return stats.agg(F.count("*").alias("docs"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("avgdl"))


def dictionary(counts: DataFrame) -> DataFrame:
    """(term, token_id, df): ids from 1 in the order of the terms, by ranges, so that no task holds all terms."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    ranged = cut(df.repartitionByRange(parallelism(df.sparkSession), "term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return ranged.withColumn("local", local).join(before.select("part", "before"), "part").select("term", (F.col("before") + F.col("local")).alias("token_id"), "df")


def _by_doc(postings: DataFrame) -> DataFrame:
    """Postings by document, in as many parts as the session asks for: the rows are few, but each will meet many queries,
    so they must not be gathered in fewer tasks for their size."""
    return postings.repartition(parallelism(postings.sparkSession), "doc")


def bm25(counts: DataFrame, stats: DataFrame, query_terms: DataFrame, allowed: DataFrame | None = None, terms: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score): BM25 of every document that shares a term with a query.

    ``query_terms`` is (query, term) with repeated terms as often as they stand, each of which counts, and k1 and b
    where a query has its own. ``allowed``, (doc) or (query, doc), filters without changing the corpus statistics.
    ``terms`` is (term, df) where an index has it. Only terms that some query has reach the join, and the corpus
    statistics are one row.
    """
    own = [c for c in ("k1", "b") if c in query_terms.columns]
    wanted = query_terms.groupBy("query", "term").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in own])
    k1_ = F.coalesce("k1", F.lit(k1)) if "k1" in own else F.lit(k1)
    b_ = F.coalesce("b", F.lit(b)) if "b" in own else F.lit(b)
    asked = query_terms.select("term").distinct()
    used = counts.select("term", "doc", "tf").join(asked, "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms.select("term", "df").join(asked, "term", "left_semi")
    whole = corpus_stats(stats)
    if allowed is not None and "query" not in allowed.columns:
        used = used.join(allowed, "doc", "left_semi")
    # by document from here on: what the queries make of the postings is added up where these are
    by_doc = _by_doc(used).join(stats.select("doc", "token_count"), "doc")
    hits = by_doc.join(wanted.join(df, "term"), "term")
    if allowed is not None and "query" in allowed.columns:
        hits = hits.join(allowed, ["query", "doc"], "left_semi")
    hits = hits.crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1_ + 1) / (F.col("tf") + k1_ * (1 - b_ + b_ * F.col("token_count") / F.col("avgdl")))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("score")).where("score > 0")


def keyword_overlap(counts: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query, doc, score): how many distinct terms a query and a document share."""
    asked = query_terms.select("query", "term").distinct()
    used = counts.select("term", "doc").join(asked.select("term").distinct(), "term", "left_semi")
    return _by_doc(used).join(asked, "term").groupBy("query", "doc").agg(F.count("*").alias("score"))


def unit_weights(counts: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight): term frequencies divided by the document's length as a vector; sparse rows throughout."""
    if norms is None:
        norms = counts.groupBy("doc").agg(F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("norm"))
    return counts.join(norms.select("doc", "norm"), "doc").select("doc", "term", (F.col("tf") / F.col("norm")).alias("weight"))


def bow_cosine(counts: DataFrame, query_counts: DataFrame, norms: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(query, doc, score): cosine of bags of words for the pairs that share a term; all other pairs have 0.

    Terms beyond the corpus vocabulary are dropped before a query is scaled to length 1. ``norms`` (doc, norm) and
    ``terms`` (term) come from an index where there is one.
    """
    known = query_counts.join((counts if terms is None else terms).select("term").distinct(), "term", "left_semi")
    weights = unit_weights(known.select(F.col("query").alias("doc"), "term", "tf")).select(F.col("doc").alias("query"), "term", F.col("weight").alias("w"))
    used = counts.select("term", "doc", "tf")
    used = used if norms is None else _by_doc(used.join(query_counts.select("term").distinct(), "term", "left_semi"))
    return unit_weights(used, norms).join(weights, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))


def bow_cosine_top(counts: DataFrame, query_counts: DataFrame, docs: DataFrame, k: int, norms: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Top k with zero scores filling up: only the k lowest ids can ever be needed for that, so no pairs are made."""
    hits = bow_cosine(counts, query_counts, norms, terms).withColumn("score", F.round("score", 6))
    # a query's hits hide at most as many of the lowest ids as it has among its own top rows
    spare = docs.select("doc").orderBy("doc").limit(2 * k)
    best = top_k(hits.where("score > 0"), "query", "doc", "score", k).drop("rank")
    known = query_counts.join((counts if terms is None else terms).select("term").distinct(), "term", "left_semi")
    fill = known.select("query").distinct().crossJoin(F.broadcast(spare)).join(best.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(fill), "query", "doc", "score", k)


def metadata_match(metadata: Column, filters: Column) -> Column:
    """Whether a map has all pairs of an array of (filter_key, filter_value); an empty or null array always matches."""
    return F.coalesce(F.forall(filters, lambda f: F.coalesce(metadata[f["filter_key"]] == f["filter_value"], F.lit(False))), F.lit(True))


def phrase_matches(positions: DataFrame, query_terms: DataFrame, slack: int = 0, places: int = 3) -> DataFrame:
    """(query, doc, hits): places where a query's terms stand in order, with up to ``slack`` more between neighbours.

    ``query_terms`` is (query, place, term), places from 0 to at most ``places`` - 1; a hit is a place of the last
    term that is reached from the first over all others. Each step joins on the exact place that the next term must
    have, for each of the slack + 1 that it may have, so the rows never exceed the places of the terms asked for times
    slack + 1.
    """
    asked = query_terms.select("term").distinct()
    spread = positions.join(asked, "term", "left_semi").select("doc", "term", F.explode("positions").alias("at"))
    sizes = query_terms.groupBy("query").agg(F.count("*").alias("size"))
    if not slack:
        # the rarest term of a phrase says where it may stand; the other terms are looked up there
        often = positions.join(asked, "term", "left_semi").groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
        rarest = query_terms.join(often, "term").groupBy("query").agg(F.min(F.struct("n", "place", "term")).alias("r"), F.count("*").alias("known"))
        rarest = rarest.join(sizes, "query").where("known = size").select("query", "size", "r.place", "r.term")
        start = rarest.join(spread, "term").select("query", "size", "doc", (F.col("at") - F.col("place")).alias("start"), F.col("place").alias("own"))
        others = start.join(query_terms, "query").where("place <> own").select("query", "size", "doc", "start", "term", (F.col("start") + F.col("place")).alias("at"))
        found = others.join(spread, ["doc", "term", "at"], "left_semi").groupBy("query", "size", "doc", "start").agg(F.count("*").alias("n")).where("n = size - 1").select("query", "doc")
        alone = start.where("size = 1").select("query", "doc")
        return found.unionByName(alone).groupBy("query", "doc").agg(F.count("*").alias("hits"))
    wanted = query_terms.join(spread, "term").select("query", "place", "doc", "at")
    reached = wanted.where("place = 0").select("query", "doc", "at", F.lit(0).alias("last"))
    all_ = reached
    for place in range(1, places):
        ahead = reached.select("query", "doc", F.explode(F.transform(F.sequence(F.lit(1), F.lit(1 + slack)), lambda d: F.col("at") + d)).alias("at"))
        reached = ahead.distinct().join(wanted.where(F.col("place") == place), ["query", "doc", "at"], "left_semi").withColumn("last", F.lit(place))
        all_ = all_.unionByName(reached)
    return all_.join(sizes, "query").where("last = size - 1").groupBy("query", "doc").agg(F.count("*").alias("hits"))
