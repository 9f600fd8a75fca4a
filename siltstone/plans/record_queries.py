"""Record queries: generations, manifests, ownership, snapshots, metadata, threads, graph walks, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.names import has_content, name_or_default
from siltstone.operators import ingest as I
from siltstone.operators import ranking as R
from siltstone.operators.lexical import metadata_match
from siltstone.session import load
from siltstone.sources.store import report_text
from siltstone.sources.synthetic import lexical_dataset
from siltstone.streaming.upserts import windowed_counts


def latest_vector_records(spark, root):
    rows = load(spark, root, "vector_records").select("chunk_id", "generation", "model_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("width"))
    return I.latest_generation(rows, "chunk_id").select("chunk_id", "generation", "model_id", "width").distinct()


def stale_postings(spark, root):
    return I.stale_rows(load(spark, root, "postings").where("chunk_id is not null").select("chunk_id", "generation"), "chunk_id").select("chunk_id", "generation", "rows")


def replay_conflicts(spark, root):
    """Vector records that stand beside lexical records of the same chunk and generation: do they agree on the resource?"""
    a, b = (load(spark, root, t).where("chunk_id is not null").select("chunk_id", "generation", "resource_id").distinct() for t in ("vector_records", "lexical_records"))
    return I.replay_conflicts(a, b, "chunk_id", ["resource_id"])


def upserted_records(spark, root):
    """Lexical records over vector records: which generation of a chunk is active after the upsert."""
    a, b = (load(spark, root, t).where("chunk_id is not null").select("chunk_id", "generation").distinct() for t in ("vector_records", "lexical_records"))
    return I.upsert(I.latest_generation(a, "chunk_id"), b, "chunk_id").select("chunk_id", "generation")


def manifest_diff(spark, root):
    old = load(spark, root, "lexical_records").where("chunk_id is not null")
    new = load(spark, root, "vector_records").where("chunk_id is not null")
    return I.manifest_diff(old, new, ["chunk_id"])


def manifest_records(spark, root):
    return I.manifest_records(load(spark, root, "chunks"))


def ownership_conflicts(spark, root):
    rows = load(spark, root, "vector_records").select("chunk_id", "resource_id").union(load(spark, root, "lexical_records").select("chunk_id", "resource_id")).union(load(spark, root, "chunks").select("chunk_id", "resource_id"))
    return I.ownership_conflicts(rows, "chunk_id", "resource_id")


def snapshot_problems(spark, root):
    found = I.snapshot_problems(load(spark, root, "documents"), load(spark, root, "chunks"))
    return found.groupBy("problem").agg(F.count("*").alias("rows"))


def erased_resources(spark, root):
    """Chunks by resource after the resources of documents without text are erased."""
    gone = load(spark, root, "documents").where("text is null").select("resource_id")
    kept = I.erase_resource(load(spark, root, "chunks").where("resource_id is not null"), gone, "resource_id")
    return kept.groupBy("resource_id").agg(F.countDistinct("chunk_id").alias("chunks"))


def metadata_filtered_chunks(spark, root):
    """How many chunks each distinct set of filters lets through."""
    sets = load(spark, root, "search_queries").where("metadata_filters is not null").select("metadata_filters").distinct()
    chunks = load(spark, root, "chunks").select(F.col("metadata")["topic"].alias("topic"), F.col("metadata")["facet"].alias("facet"), "chunk_id").groupBy("topic", "facet").agg(F.countDistinct("chunk_id").alias("n"))
    # distinct metadata against distinct filters: both sides are as small as their values are few
    rebuilt = chunks.withColumn("metadata", F.map_filter(F.create_map(F.lit("topic"), F.col("topic"), F.lit("facet"), F.col("facet")), lambda k, v: v.isNotNull()))
    hits = sets.crossJoin(rebuilt).where(metadata_match(F.col("metadata"), F.col("metadata_filters")))
    return hits.groupBy(F.concat_ws("&", F.transform("metadata_filters", lambda f: F.concat_ws("=", f["filter_key"], f["filter_value"]))).alias("filters")).agg(F.sum("n").alias("chunks"))


def metadata_functions(spark, root):
    m = F.col("metadata")
    rows = load(spark, root, "chunks").where("metadata is not null")
    changed = F.map_concat(F.map_filter(m, lambda k, v: k != "facet"), F.create_map(F.lit("seen"), F.lit("yes")))
    return rows.select("chunk_id", F.map_contains_key(m, "facet").alias("has_facet"), F.try_element_at(m, F.lit("facet")).alias("facet"), F.size(changed).alias("keys"), changed["seen"].alias("seen")).distinct()


def threads(spark, root):
    return I.messages_to_threads(load(spark, root, "events"), "user_id", ["ts", "event_id"], "event_type")


def thread_positions(spark, root):
    """Every event's place among those of its user."""
    return I.thread_messages(load(spark, root, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "position")


def content_copies(spark, root):
    """Documents whose kind and text another document has as well."""
    return I.content_classes(load(spark, root, "documents"), "doc_id", ["kind"], "text").where("copies > 1").select("unit", "digest", "first", "copies")


def graph_walk(spark, root):
    """From every 20th part over its heaviest suppliers to their heaviest parts."""
    line = load(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    there = line.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.lit("made_by").alias("kind"), "weight")
    back = line.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.lit("makes").alias("kind"), "weight")
    seeds = load(spark, root, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("seed"))
    return R.walk(there.unionByName(back), seeds, 2, 3)


def graph_walk_edges(spark, root):
    """The 20 edges of a walk from every 50th part."""
    line = load(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    there = line.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.lit("made_by").alias("kind"), "weight")
    back = line.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.lit("makes").alias("kind"), "weight")
    seeds = load(spark, root, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("seed"))
    return R.walked_edges(there.unionByName(back), seeds, 2, 20)


def parsed_kinds(spark, root):
    """Documents by the kind that they name in any letter case, and by whether they have content."""
    docs = load(spark, root, "documents")
    return docs.groupBy(name_or_default("source_kind", F.col("kind")).alias("kind"), has_content(F.col("text")).alias("content")).agg(F.count("*").alias("rows"))


def echo_scores(spark, root):
    """Events' values decayed by a day, nothing within an hour of the newest, purchases counted as an own echo."""
    events = load(spark, root, "events").where("value is not null and ts is not null")
    newest = events.agg(F.max("ts").alias("newest"))
    age = (F.unix_timestamp("newest") - F.unix_timestamp("ts")) / F.lit(3600.0)
    made = events.crossJoin(F.broadcast(newest)).withColumn("s", R.decayed(F.col("value"), age, 24.0, cooldown=1.0, own=F.col("event_type") == "purchase"))
    return made.groupBy("event_type").agg(F.round(F.sum("s"), 4).alias("score"))


def event_windows(spark, root):
    made = windowed_counts(load(spark, root, "events").where("ts is not null"), "ts", "1 hour", "2 hours", "event_type")
    return made.select(F.col("window.start").alias("started"), "event_type", "rows")


def event_properties(spark, root):
    """Events by type and number of properties in their JSON."""
    keys = F.size(F.json_object_keys("props"))
    return load(spark, root, "events").select("event_type", F.coalesce(keys, F.lit(-1)).alias("keys")).groupBy("event_type", "keys").agg(F.count("*").alias("rows"))


def report_rows(spark, root):
    from siltstone.plans.evaluation_queries import latency_percentiles

    return report_text(latency_percentiles(spark, root).select("event_type", "count"))


def synthetic_classes(spark, root):
    made = lexical_dataset(spark, 500, 400)
    return made["queries"].join(made["qrels"], "query_id", "left").groupBy("query_type").agg(F.count("*").alias("queries"), F.count("item_id").alias("judged"))


QUERIES = {f.__name__: f for f in (latest_vector_records, stale_postings, replay_conflicts, upserted_records, manifest_diff, manifest_records, ownership_conflicts, snapshot_problems, erased_resources, metadata_filtered_chunks, metadata_functions, threads, thread_positions, content_copies, graph_walk, graph_walk_edges, parsed_kinds, echo_scores, event_windows, event_properties, report_rows, synthetic_classes)}

EDGES = """WITH l AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY ALL),
ed AS (SELECT 'p' || p AS source, 's' || s AS target, 'made_by' AS kind, w FROM l UNION ALL SELECT 's' || s, 'p' || p, 'makes', w FROM l),
b AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, kind, target) AS r FROM ed) WHERE r <= 3),
z AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0),
one AS (SELECT DISTINCT seed, target AS node FROM z JOIN b ON b.source = seed), two AS (SELECT DISTINCT seed, target AS node FROM one JOIN b ON b.source = node),
a AS (SELECT seed, seed AS node, 0 AS depth FROM z UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two)
SELECT seed, node, min(depth)::INT AS depth FROM a GROUP BY ALL"""

SQL = {
    "latest_vector_records": "SELECT DISTINCT chunk_id, generation, model_id, coalesce(len(embedding), -1)::INT AS width FROM vector_records JOIN (SELECT chunk_id, max(generation) AS generation FROM vector_records GROUP BY 1) USING (chunk_id, generation)",
    "stale_postings": "SELECT p.chunk_id, p.generation, count(*) AS rows FROM postings p JOIN (SELECT chunk_id, max(generation) AS top FROM postings GROUP BY 1) USING (chunk_id) WHERE generation < top GROUP BY ALL",
    "replay_conflicts": "SELECT chunk_id, generation, max((a.resource_id IS DISTINCT FROM b.resource_id)::INT) AS conflict FROM (SELECT DISTINCT chunk_id, generation, resource_id FROM vector_records) a JOIN (SELECT DISTINCT chunk_id, generation, resource_id FROM lexical_records) b USING (chunk_id, generation) GROUP BY ALL",
    "upserted_records": "WITH a AS (SELECT chunk_id, max(generation) AS g FROM vector_records WHERE chunk_id IS NOT NULL GROUP BY 1), b AS (SELECT chunk_id, max(generation) AS h FROM lexical_records WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT chunk_id, CASE WHEN h IS NOT NULL AND (g IS NULL OR h >= g) THEN h ELSE g END AS generation FROM a FULL JOIN b USING (chunk_id)",
    "manifest_diff": "WITH a AS (SELECT DISTINCT chunk_id FROM lexical_records WHERE chunk_id IS NOT NULL), b AS (SELECT DISTINCT chunk_id FROM vector_records WHERE chunk_id IS NOT NULL) SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'insert' WHEN b.chunk_id IS NULL THEN 'reclaim' ELSE 'retain' END AS action FROM a FULL JOIN b ON a.chunk_id = b.chunk_id",
    "manifest_records": "WITH d AS (SELECT DISTINCT resource_id, doc_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL) SELECT resource_id, chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1)::INT AS ordinal, unnest(['chunk', 'embedding', 'vector_record']) AS kind FROM d",
    "ownership_conflicts": "SELECT chunk_id, count(DISTINCT resource_id) AS owners FROM (SELECT chunk_id, resource_id FROM vector_records UNION ALL SELECT chunk_id, resource_id FROM lexical_records UNION ALL SELECT chunk_id, resource_id FROM chunks) WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT resource_id) > 1",
    "snapshot_problems": """WITH c AS (SELECT DISTINCT chunk_id, doc_id, source_range, text FROM chunks),
p AS (SELECT 'document without text' AS problem FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'chunk without document' FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'range missing' FROM c WHERE source_range IS NULL UNION ALL SELECT 'range differs from text' FROM c WHERE source_range.byte_length <> octet_length(encode(text)))
SELECT problem, count(*) AS rows FROM p GROUP BY 1""",
    "erased_resources": "SELECT resource_id, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE resource_id IS NOT NULL AND resource_id NOT IN (SELECT resource_id FROM documents WHERE text IS NULL AND resource_id IS NOT NULL) GROUP BY 1",
    "metadata_filtered_chunks": "WITH f AS (SELECT DISTINCT metadata_filters AS mf FROM search_queries WHERE metadata_filters IS NOT NULL), c AS (SELECT metadata, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) SELECT array_to_string(list_transform(mf, lambda f: concat_ws('=', f.filter_key, f.filter_value)), '&') AS filters, sum(n)::BIGINT AS chunks FROM f, c WHERE len(list_filter(mf, lambda f: coalesce(metadata[f.filter_key], '') <> f.filter_value)) = 0 GROUP BY 1",
    "metadata_functions": "SELECT DISTINCT chunk_id, list_contains(map_keys(metadata), 'facet') AS has_facet, metadata['facet'] AS facet, (len(map_keys(metadata)) - list_contains(map_keys(metadata), 'facet')::INT + 1)::INT AS keys, 'yes' AS seen FROM chunks WHERE metadata IS NOT NULL",
    "threads": "SELECT user_id, count(*) AS messages, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "thread_positions": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS position FROM events WHERE user_id IS NOT NULL",
    "content_copies": "WITH d AS (SELECT doc_id, kind, sha256(text) AS digest FROM documents), c AS (SELECT kind, digest, min(doc_id) AS first, count(*) AS copies FROM d GROUP BY ALL) SELECT doc_id AS unit, d.digest, first, copies FROM d JOIN c ON d.kind IS NOT DISTINCT FROM c.kind AND d.digest IS NOT DISTINCT FROM c.digest WHERE copies > 1",
    "graph_walk": EDGES,
    "graph_walk_edges": """WITH l AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity::BIGINT)::BIGINT AS w FROM lineitem GROUP BY ALL),
ed AS (SELECT 'p' || p AS source, 's' || s AS target, 'made_by' AS kind, w AS weight FROM l UNION ALL SELECT 's' || s, 'p' || p, 'makes', w FROM l),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, kind, target) AS r FROM ed) WHERE r <= 20),
z AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 50 = 0),
one AS (SELECT * FROM (SELECT seed, source, target, kind, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, kind, source, target) AS r FROM z JOIN b ON source = seed) WHERE r <= 20),
n1 AS (SELECT seed, count(*) AS n FROM one GROUP BY 1), f AS (SELECT DISTINCT seed, target AS node FROM one),
two AS (SELECT t.*, row_number() OVER (PARTITION BY t.seed ORDER BY weight DESC, kind, source, target) AS r FROM (SELECT f.seed, source, target, kind, weight FROM f JOIN b ON source = node) t WHERE target <> t.seed AND (t.seed, target) NOT IN (SELECT (seed, node) FROM f))
SELECT seed, source, target, kind, weight, 1 AS depth FROM one UNION ALL SELECT seed, source, target, kind, weight, 2 FROM two JOIN n1 USING (seed) WHERE r <= 20 - n""",
    "parsed_kinds": "SELECT CASE WHEN lower(kind) IN ('text', 'markdown', 'chat', 'code', 'structured', 'event', 'custom', 'unknown') THEN lower(kind) ELSE 'unknown' END AS kind, coalesce(text <> '', false) AS content, count(*) AS rows FROM documents GROUP BY ALL",
    "echo_scores": """WITH e AS (SELECT *, (floor(epoch(max(ts) OVER ()))::BIGINT - floor(epoch(ts))::BIGINT) / 3600.0::DOUBLE AS age FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)
SELECT event_type, round(sum(CASE WHEN age < 1 THEN 0 ELSE value * exp(-age / 24) END * CASE WHEN event_type = 'purchase' THEN 0.3::DOUBLE ELSE 1 END), 4) AS score FROM e GROUP BY 1""",
    "report_rows": """SELECT '{"event_type":"' || event_type || '","count":' || count(*) || '}' AS value FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "synthetic_classes": "SELECT unnest(['exact', 'partial', 'graded', 'distractor_heavy', 'oov', 'no_answer', 'length_bias', 'repeated_term']) AS query_type, 50::BIGINT AS queries, unnest([50, 50, 50, 50, 0, 0, 50, 50])::BIGINT AS judged",
    "event_windows": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_properties": "SELECT event_type, coalesce(len(json_keys(props)), -1)::INT AS keys, count(*) AS rows FROM events GROUP BY ALL",
}
