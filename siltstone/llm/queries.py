"""The queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.distinctive import current_records, distinctive_terms
from siltstone.llm.frequency import current_postings, term_frequencies
from siltstone.llm.fusion import fused_ranking
from siltstone.llm.markup import clean_markup, wrappers
from siltstone.llm.mixing import mix, normal_source
from siltstone.llm.neighbours import current_vectors, nearest
from siltstone.llm.packing import pack
from siltstone.llm.sentences import fit, sentences
from siltstone.llm.splitting import split_oversized
from siltstone.llm.topn import top_n_per_group
from siltstone.session import load, stored


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return clean_markup(load(spark, root, "documents")).select("doc_id", F.explode("elements").alias("element"))


def p1_clean_text(spark: SparkSession, root: str) -> DataFrame:
    """Every text cleaned, and the clean text parsed once more: whether it has no residue besides the structures that are
    kept, whether these are the same as before, and whether a second cleaning changes nothing."""
    docs = load(spark, root, "documents").select("doc_id", "source_uri", "text")
    induced = stored(wrappers(docs))
    once = clean_markup(docs.withColumn("doc", F.struct("doc_id", "source_uri")), "doc", induced=induced).where("clean_text is not null")
    before = once.select(F.struct("doc.*", "elements", "clean_text").alias("doc"), "doc.source_uri", F.col("clean_text").alias("text"))
    twice = clean_markup(before, "doc", induced=induced)
    kept = F.array_remove("doc.elements", "other")
    return twice.select("doc.doc_id", (~F.array_contains("elements", "other")).alias("no_residue"), (F.array_remove("elements", "other") == kept).alias("structure_kept"), (F.col("clean_text") == F.col("doc.clean_text")).alias("stable"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return top_n_per_group(load(spark, root, "vector_hits"), load(spark, root, "search_queries")).select("query_id", "chunk_id")


def p2_places(spark: SparkSession, root: str) -> DataFrame:
    return top_n_per_group(load(spark, root, "vector_hits"), load(spark, root, "search_queries")).select("query_id", "chunk_id", "place")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    near = nearest(current_vectors(load(spark, root, "vector_records")), least=0.85)
    return near.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()


def p3_cosines(spark: SparkSession, root: str) -> DataFrame:
    near = nearest(current_vectors(load(spark, root, "vector_records")), least=0.85)
    return near.select("chunk_id", "other", F.round("cosine", 6).alias("cosine"), "place")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    valid = current_postings(load(spark, root, "postings")).where("token_id is not null and token_id <> 0")
    return term_frequencies(valid, "token_id", "chunk_id", "term_frequency", unique=True).where("mark is not null").select(F.col("term").alias("token_id"), "mark")


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    valid = current_postings(load(spark, root, "postings")).where("token_id is not null and token_id <> 0")
    return term_frequencies(valid, "token_id", "chunk_id", "term_frequency", unique=True).select(F.col("term").alias("token_id"), "term_code", "occurrences", "records")


def _items(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), "text")
    chunks = load(spark, root, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return docs.unionByName(chunks).withColumn("item", F.struct("item_kind", "item_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_oversized(_items(spark, root), "item").where("piece_count > 1")
    # a run above the limit forces a hard cut; pieces tell which texts were cut, the run how
    return pieces.where("piece = 0").select("item.item_kind", "item.item_id", F.when(F.col("unbroken"), "hard").otherwise("soft").alias("cut")).distinct()


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """By kind of item: texts, the bytes that their pieces cover without the overlaps, and pieces that break a promise:
    above the limit, of another size than their range, or with another overlap than 120 bytes (less 3 in a character, or all that stands before)."""
    pieces = split_oversized(_items(spark, root), "item")
    length = F.col("source_range.byte_length")
    bad = (length > 2400) | (F.octet_length("text") != length) | ((F.col("piece") > 0) & ((F.col("overlap") > 120) | ((F.col("overlap") < 117) & (F.col("source_range.byte_offset") > 0)))) | ((F.col("piece") == 0) & (F.col("overlap") != 0))
    sums = pieces.select("item.item_kind", (F.col("piece") == 0).cast("long").alias("first"), (length - F.col("overlap")).alias("own"), bad.cast("long").alias("bad"))
    return sums.groupBy("item_kind").agg(F.sum("first").alias("texts"), F.sum("own").alias("bytes"), F.sum("bad").alias("bad_pieces"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_ranked(spark, root).where("place_0 <= 5 and place_1 <= 5 and place_2 <= 5").select("query_id", "chunk_id")


def p6_ranked(spark: SparkSession, root: str) -> DataFrame:
    tables = (("vector_hits", "score", True), ("signature_hits", "hamming_distance", False), ("lexical_hits", "score", True))
    made = fused_ranking([(load(spark, root, t), c, up) for t, c, up in tables])
    return made.withColumn("flow", F.round("flow", 6) + F.lit(0.0))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    scored = distinctive_terms(current_records(load(spark, root, "lexical_records")))
    return scored.where("term_count >= 4 and term_count * 10 >= token_count and records between 2 and 12").select("chunk_id", "term")


def p7_scores(spark: SparkSession, root: str) -> DataFrame:
    scored = distinctive_terms(current_records(load(spark, root, "lexical_records")))
    return scored.select("chunk_id", "term", "term_count", "token_count", "records", F.round("score", 6).alias("score"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return pack(load(spark, root, "documents"), "doc_id", text="text").where("piece_count > 1 and piece = 0").select("doc_id")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack(load(spark, root, "documents"), "doc_id", text="text").groupBy("container").agg(F.sum("size").alias("filled"), F.count("*").alias("pieces"))


def p8_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row: pieces and tokens, overfull containers, and whether the containers are at least 98 % full."""
    bins = p8_containers(spark, root)
    sums = bins.agg(F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.sum((F.col("filled") > 6144).cast("long")).alias("overfull"), F.count("*").alias("containers"))
    return sums.select("pieces", "tokens", "overfull", (F.col("containers") * 6144 * 0.98 <= F.col("tokens") + 6144).alias("well_filled"))


def _report(spark: SparkSession, root: str) -> DataFrame:
    topics = load(spark, root, "chunks").select("doc_id", F.col("metadata")["topic"].alias("topic"))
    return mix(load(spark, root, "documents"), load(spark, root, "mix_targets"), topics)[1]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _report(spark, root).where("not reachable").select("source")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """What each source has and is to give, and whether the mix holds that: within one document of its goal, which is
    its share of the mix's size, or all it has times its repeats. How much of the mix it became stands in the report."""
    made = _report(spark, root)
    return made.select("source", "target_share", "max_repeats", "documents", "tokens", "most_tokens", "reachable", F.round("goal_tokens").cast("long").alias("goal_tokens"), "on_goal")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    asked = docs.where(normal_source(F.col("source")).isin("field-notes", "interviews", "translations"))
    return sentences(asked, model=fit(docs)).select("doc_id", "sent_start", "sent_end")


def p10_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Every document's sentences, counted, with the characters that they cover besides white space."""
    made = sentences(load(spark, root, "documents"))
    letters = F.length(F.regexp_replace("sentence_text", WHITE, "")).cast("long")
    return made.groupBy("doc_id").agg(F.sum(letters).alias("letters"), F.min("sent_start").alias("first_start"), F.max("sent_end").alias("last_end"))


#: White space in Java and in DuckDB alike.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


SQL_P4 = """
WITH top AS (SELECT chunk_id, max(generation) AS generation FROM postings WHERE chunk_id IS NOT NULL GROUP BY 1),
one AS (SELECT token_id, chunk_id, max(term_frequency) AS tf FROM postings JOIN top USING (chunk_id, generation)
  WHERE token_id <> 0 AND term_frequency >= 1 GROUP BY 1, 2),
per AS (SELECT token_id, sum(tf)::BIGINT AS occurrences, count(*) AS records FROM one GROUP BY 1),
n AS (SELECT count(DISTINCT chunk_id) AS n FROM one)
"""

SQL_P9 = """
WITH t AS (SELECT source, target_share, max_repeats FROM mix_targets),
d AS (SELECT replace(lower(trim(source)), '_', '-') AS source, coalesce(octet_length(encode(text)), 0) AS tokens FROM documents),
l AS (SELECT d.* FROM d JOIN t USING (source)),
s AS (SELECT t.*, coalesce(n, 0)::BIGINT AS documents, coalesce(b, 0)::BIGINT AS tokens FROM t LEFT JOIN (SELECT source, count(*) AS n, sum(tokens) AS b FROM l GROUP BY 1) USING (source)),
m AS (SELECT *, (tokens * max_repeats)::BIGINT AS most_tokens FROM s),
f AS (SELECT *, most_tokens >= target_share * (SELECT sum(tokens) FROM l) AS reachable FROM m),
r AS (SELECT most_tokens / target_share AS reach, target_share AS w FROM m WHERE most_tokens > 0 AND target_share > 0),
c AS (SELECT reach, sum(w) OVER (ORDER BY reach DESC) AS upto, sum(w) OVER () AS all_ FROM r),
g AS (SELECT max(reach) AS total FROM c WHERE upto >= 0.9::DOUBLE * all_ - 1e-12)
"""


def _pair(d: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({d} - 0.05::DOUBLE) / 0.45::DOUBLE))"


def _flows(k: int, table: str, value: str, sign: str) -> str:
    """Net flow by comparing every pair of distinct values, weighted by how many items have them."""
    return f"""
b{k} AS (SELECT query_id, chunk_id, {"max" if sign == "" else "min"}({value})::DOUBLE * {sign}1 AS v FROM {table}
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND {value} IS NOT NULL AND NOT isnan({value}::DOUBLE) GROUP BY 1, 2),
x{k} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS place, count(*) OVER (PARTITION BY query_id) AS n,
  (2 * (rank() OVER (PARTITION BY query_id ORDER BY v) - 1) + count(*) OVER (PARTITION BY query_id, v)) / (2 * count(*) OVER (PARTITION BY query_id)) AS x FROM b{k}),
t{k} AS (SELECT query_id, x, any_value(n) AS n, count(*) AS c FROM x{k} GROUP BY 1, 2),
f{k} AS (SELECT a.query_id, a.x, sum(b.c * ({_pair("a.x - b.x")} - {_pair("b.x - a.x")})) / greatest(1, any_value(a.n) - 1) AS flow FROM t{k} a JOIN t{k} b USING (query_id) GROUP BY 1, 2),
y{k} AS (SELECT query_id, chunk_id, place, flow FROM x{k} JOIN f{k} USING (query_id, x))"""


def _best(table: str, value: str, order: str) -> str:
    return f"""SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v {order}, chunk_id) AS p
  FROM (SELECT query_id, chunk_id, {"max" if order == "DESC" else "min"}({value}) AS v FROM {table}
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND {value} IS NOT NULL AND NOT isnan({value}::DOUBLE) GROUP BY 1, 2)) WHERE p <= 5"""


SQL_P2 = """
WITH q AS (SELECT query_id, max(coalesce(hit_limit, 10)) AS n FROM search_queries WHERE query_id IS NOT NULL GROUP BY 1),
h AS (SELECT query_id, chunk_id, max(score) AS score FROM vector_hits
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM h JOIN q USING (query_id))
"""

SQL_P3 = """
WITH top AS (SELECT chunk_id, max(generation) AS generation FROM vector_records WHERE chunk_id IS NOT NULL GROUP BY 1),
v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vector_records JOIN top USING (chunk_id, generation)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS p FROM s)
"""

SQL_P7 = r"""
WITH c AS (SELECT chunk_id, max(struct_pack(generation := generation, tokens := tokens)) AS last FROM lexical_records WHERE chunk_id IS NOT NULL GROUP BY 1),
t AS (SELECT chunk_id, lower(trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS term FROM (SELECT chunk_id, unnest(last.tokens) AS x FROM c)),
k AS (SELECT * FROM t WHERE term <> ''),
n AS (SELECT chunk_id, count(*) AS n FROM k GROUP BY 1),
f AS (SELECT chunk_id, term, count(*) AS tf FROM k GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df, sum(tf) AS seen FROM f GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_clean_text": "SELECT doc_id, true AS no_residue, true AS structure_kept, true AS stable FROM documents WHERE text IS NOT NULL",
        "p2_found": SQL_P2 + "SELECT query_id, chunk_id FROM r WHERE place <= n",
        "p2_places": SQL_P2 + "SELECT query_id, chunk_id, place FROM r WHERE place <= n",
        "p3_found": SQL_P3 + "SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE p <= 5 AND c > 0.85",
        "p3_cosines": SQL_P3 + "SELECT a AS chunk_id, b AS other, round(c, 6) AS cosine, p AS place FROM r WHERE p <= 5 AND c > 0.85",
        "p4_found": SQL_P4 + "SELECT token_id, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark FROM per, n WHERE records < 3 OR records * 4 > n",
        "p4_counts": SQL_P4 + "SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS term_code, occurrences, records FROM per",
        "p5_found": r"""
WITH i AS (SELECT 'document' AS item_kind, doc_id::VARCHAR AS item_id, text FROM documents
  UNION SELECT 'chunk', chunk_id, text FROM chunks)
SELECT DISTINCT item_kind, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\v\p{Z}\x{1c}-\x{1f}\x{85}。！？]+'), lambda x: octet_length(encode(x)))) > 2400 THEN 'hard' ELSE 'soft' END AS cut
FROM i WHERE octet_length(encode(text)) > 2400""",
        "p5_pieces": """
WITH i AS (SELECT 'document' AS item_kind, text FROM documents UNION ALL SELECT 'chunk', text FROM chunks)
SELECT item_kind, count(*) AS texts, sum(octet_length(encode(text)))::BIGINT AS bytes, 0::BIGINT AS bad_pieces FROM i WHERE text IS NOT NULL GROUP BY 1""",
        "p6_ranked": "WITH" + ",".join(_flows(k, *t) for k, t in enumerate((("vector_hits", "score", ""), ("signature_hits", "hamming_distance", "-"), ("lexical_hits", "score", "")))) + """,
u AS (SELECT query_id, chunk_id, (coalesce(y0.flow, 0) + coalesce(y1.flow, 0) + coalesce(y2.flow, 0)) / 3 AS flow, y0.place AS place_0, y1.place AS place_1, y2.place AS place_2
  FROM y0 FULL JOIN y1 USING (query_id, chunk_id) FULL JOIN y2 USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(flow, 6) + 0 AS flow, row_number() OVER (PARTITION BY query_id ORDER BY round(flow, 9) DESC, chunk_id) AS place, place_0, place_1, place_2 FROM u""",
        "p6_found": "\nINTERSECT\n".join((_best("vector_hits", "score", "DESC"), _best("signature_hits", "hamming_distance", "ASC"), _best("lexical_hits", "score", "DESC"))),
        "p7_found": SQL_P7 + "SELECT chunk_id, term FROM f JOIN n USING (chunk_id) JOIN d USING (term) WHERE tf >= 4 AND tf * 10 >= n AND df BETWEEN 2 AND 12",
        "p7_scores": SQL_P7 + """, w AS (SELECT sum(n) AS all_, sum(n) / count(*) AS mu FROM n),
z AS (SELECT chunk_id, term, tf, n, df, (tf + mu * seen / all_) / (n + mu) AS q, seen / all_ AS p FROM f JOIN n USING (chunk_id) JOIN d USING (term), w WHERE df >= 2)
SELECT chunk_id, term, tf AS term_count, n AS token_count, df AS records, round(q * ln(q / p), 6) AS score FROM z""",
        "p8_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 6144",
        "p8_totals": """
WITH d AS (SELECT coalesce(octet_length(encode(text)), 0) AS n FROM documents)
SELECT sum(greatest(1, ceil(n / 6144)))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS overfull, true AS well_filled FROM d""",
        "p9_found": SQL_P9 + "SELECT source FROM f WHERE NOT reachable",
        "p9_shares": SQL_P9 + "SELECT source, target_share, max_repeats::BIGINT AS max_repeats, documents, tokens, most_tokens, reachable, round(least(target_share * total, most_tokens))::BIGINT AS goal_tokens, true AS on_goal FROM f, g",
        "p10_sentences": f"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '{WHITE}', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t) AS letters, length(regexp_extract(text, '^{WHITE}')) AS first_start, length(regexp_replace(text, '{WHITE}$', '')) AS last_end FROM d WHERE t <> ''""",
    }
