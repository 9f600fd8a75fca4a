"""Vector and signature queries over embeddings. Queries are the rows whose id is divisible by 20, against all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions.vector import dot, finite, negative_squared_l2, squared_norm
from siltstone.operators import evaluation as E
from siltstone.operators import probing as P
from siltstone.operators import quantize as Q
from siltstone.operators import signatures as S
from siltstone.operators import vectors as V
from siltstone.session import load

WIDTH, K = 64, 10


def embeddings(spark, root):
    return load(spark, root, "embeddings")


def asked(spark, root):
    return embeddings(spark, root).where("vec_id % 20 = 0")


def signs(spark, root):
    return S.sign_signatures(embeddings(spark, root), "vec_id", "embedding", WIDTH)


def asked_signs(spark, root):
    return S.sign_signatures(asked(spark, root), "vec_id", "embedding", WIDTH)


def _exact(metric):
    def query(spark, root):
        return V.exact_top_k(embeddings(spark, root), asked(spark, root), "vec_id", "embedding", WIDTH, metric, K)

    return query


def cosine_same_label(spark, root):
    """Only rows with label 3 are searched; the filter comes before the scores."""
    return V.exact_top_k(embeddings(spark, root).where("label = 3"), asked(spark, root), "vec_id", "embedding", WIDTH, "cosine", K)


def vector_norms(spark, root):
    e = F.col("embedding")
    first = F.array(*[e[i] for i in range(WIDTH // 2)])
    last = F.array(*[e[i] for i in range(WIDTH // 2, WIDTH)])
    return embeddings(spark, root).select("vec_id", finite(e, WIDTH).alias("usable"), F.round(squared_norm(e), 6).alias("squared_norm"), F.round(dot(first, last), 6).alias("half_dot"), F.round(negative_squared_l2(first, last), 6).alias("half_l2"))


def sign_pack_words(spark, root):
    return signs(spark, root).select("id", F.col("words")[0].alias("word"))


def hamming_topk(spark, root):
    return S.hamming_top_k(signs(spark, root), asked_signs(spark, root), 1, K)


def multiprobe_topk(spark, root):
    return S.multiprobe(signs(spark, root), asked_signs(spark, root), WIDTH, K)[0]


def probe_diagnostics(spark, root):
    return S.multiprobe(signs(spark, root), asked_signs(spark, root), WIDTH, K)[1]


def band_candidates(spark, root):
    """How many candidates eight bands give within radius 12, and how many of them are that near."""
    found = S.band_candidates(signs(spark, root), asked_signs(spark, root), WIDTH, 8, 12)
    both = found.join(signs(spark, root).withColumnRenamed("id", "item"), "item").join(asked_signs(spark, root).select(F.col("id").alias("query"), F.col("words").alias("w")), "query")
    near = F.bit_count(F.col("words")[0].bitwiseXOR(F.col("w")[0])) <= 12
    return both.groupBy("query").agg(F.count("*").alias("candidates"), F.sum(near.cast("long")).alias("near"))


def hamming_rerank_coverage(spark, root):
    """Share of the exact top 10 that are among the 100 nearest signatures."""
    exact = _exact("cosine")(spark, root).select("query", "item")
    return E.coverage(exact, S.hamming_top_k(signs(spark, root), asked_signs(spark, root), 1, 100), K).select("query", F.round("coverage", 6).alias("coverage"))


def signature_buckets(spark, root):
    return S.signature_buckets(signs(spark, root)).groupBy("size").agg(F.count("*").alias("buckets"))


def _label_signs(spark, root):
    return signs(spark, root).join(embeddings(spark, root).select(F.col("vec_id").alias("id"), "label"), "id")


def _aggregate(rule, share=0.5):
    def query(spark, root):
        return S.aggregate_signatures(_label_signs(spark, root), WIDTH, "label", rule, share).select("label", F.col("words")[0].alias("word"))

    return query


def bit_ones(spark, root):
    counted = S.bit_counts(signs(spark, root), WIDTH)
    return counted.select("n", F.posexplode("ones").alias("bit", "ones")).select("bit", F.round(F.col("ones") / F.col("n"), 6).alias("fraction"))


def code_health(spark, root):
    one = S.code_health(signs(spark, root), WIDTH)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def bit_correlations(spark, root):
    made = S.bit_correlations(signs(spark, root), WIDTH, None)
    return made.select("a", "b", F.round("correlation", 6).alias("correlation"))


def participation_ratio(spark, root):
    """Squared trace over squared Frobenius norm of the bits' correlations."""
    made = S.bit_correlations(signs(spark, root), WIDTH, None)
    sums = made.agg(F.sum(F.col("correlation") * F.col("correlation")).alias("off"), F.countDistinct(F.col("a")).alias("na"), F.count("*").alias("pairs"))
    bits = (1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2
    return sums.select(F.round(bits * bits / (bits + 2 * F.col("off")), 4).alias("ratio"))


def pairwise_hamming(spark, root):
    made = S.all_pairs_stats(signs(spark, root), 1)
    return made.select("pairs", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most")


def cosine_hamming_correlation(spark, root):
    """Pearson's correlation of cosine and negated Hamming distance over all pairs of a query and another row."""
    made = V.cosine_hamming_pearson(embeddings(spark, root), asked(spark, root), "vec_id", "embedding", WIDTH)
    return made.select(F.round("pearson", 6).alias("pearson"))


def scalar_code_entropy(spark, root):
    codes = Q.scalar_codes(embeddings(spark, root), "vec_id", "embedding", Q.equal_mass_thresholds(embeddings(spark, root), "vec_id", "embedding", 4))
    return Q.code_entropy(codes).select("dim", F.round("entropy", 6).alias("entropy"))


def scalar_code_centers(spark, root):
    codes = Q.scalar_codes(embeddings(spark, root), "vec_id", "embedding", Q.equal_mass_thresholds(embeddings(spark, root), "vec_id", "embedding", 4))
    return Q.code_centers(codes).select("dim", "code", F.round("center", 6).alias("center"), "n")


def ternary_planes(spark, root):
    made = Q.ternary_codes(embeddings(spark, root), "vec_id", "embedding", WIDTH, 0.1)
    return made.select("id", F.col("nonzero")[0].alias("nonzero"), F.col("sign")[0].alias("sign"))


def ternary_group_distance(spark, root):
    """Mean ternary distance of the queries to the rows of each label."""
    rows = Q.ternary_codes(embeddings(spark, root), "vec_id", "embedding", WIDTH, 0.1)
    a = asked(spark, root).select(F.col("vec_id").alias("id")).join(rows, "id").select("id", F.col("nonzero").alias("a_nonzero"), F.col("sign").alias("a_sign"))
    b = rows.join(embeddings(spark, root).select(F.col("vec_id").alias("id"), "label"), "id").select("label", F.col("nonzero").alias("b_nonzero"), F.col("sign").alias("b_sign"))
    # a stated query set against all rows
    return a.crossJoin(b).groupBy("id", "label").agg(F.round(F.avg(Q.ternary_distance("a_", "b_", 1)), 6).alias("distance"))


def _encoded(make, sampled):
    def query(spark, root):
        e = embeddings(spark, root)
        encoder = make(S.fit_sample(e, "vec_id", "embedding")) if sampled else make()
        words = (len(encoder.rows) + 63) // 64
        return S.hamming_top_k(encoder.encode(e, "vec_id", "embedding"), encoder.encode(asked(spark, root), "vec_id", "embedding"), words, K)

    return query


def itq_cascade(spark, root):
    e = embeddings(spark, root)
    return S.cascade(e, asked(spark, root), "vec_id", "embedding", S.itq(S.fit_sample(e, "vec_id", "embedding"), WIDTH))


def pq_topk(spark, root):
    e = embeddings(spark, root)
    quantizer = Q.ProductQuantizer(S.fit_sample(e, "vec_id", "embedding"))
    return Q.pq_top_k(quantizer.encode(e, "vec_id", "embedding"), quantizer, asked(spark, root), "vec_id", "embedding", K)


def opq_topk(spark, root):
    e = embeddings(spark, root)
    quantizer = Q.ProductQuantizer(S.fit_sample(e, "vec_id", "embedding"), rotate=3)
    return Q.pq_top_k(quantizer.encode(e, "vec_id", "embedding"), quantizer, asked(spark, root), "vec_id", "embedding", K)


def _weights(bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded weights and biases as an encoder's file holds them."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(bits, WIDTH)).astype(np.float32).astype(float), (0.2 * rng.normal(size=bits)).astype(np.float32).astype(float)


def autoencoder_topk(spark, root):
    """96 bits of a layer of 96 x 64 weights and 96 biases."""
    return _encoded(lambda: S.autoencoder(*_weights(96, 5)), False)(spark, root)


def _books() -> np.ndarray:
    return np.round(0.15 * np.random.default_rng(11).normal(size=(8, 16, 8)), 4)


def pq_stored_topk(spark, root):
    """Product quantization by stored codebooks: 8 parts of 16 centers."""
    quantizer = Q.ProductQuantizer.from_books(_books())
    return Q.pq_top_k(quantizer.encode(embeddings(spark, root), "vec_id", "embedding"), quantizer, asked(spark, root), "vec_id", "embedding", K)


def adc_rerank(spark, root):
    """The 50 nearest signatures of 64 hyperplanes, by the squared gap of the query's projections to the bits' centers."""
    encoder = S.random_hyperplanes(64, WIDTH)
    coded = encoder.encode(embeddings(spark, root), "vec_id", "embedding")
    own = encoder.encode(asked(spark, root), "vec_id", "embedding", projections=True)
    near = S.hamming_top_k(coded, own.select("id", "words"), 1, 50).select("query", "item")
    centers = np.stack([np.full(64, -0.8), np.full(64, 0.8)], 1)
    scored = S.adc_scores(near.join(coded.withColumnRenamed("id", "item"), "item"), own, centers)
    return S.top_k(scored.withColumn("score", F.round(-F.col("score"), 6)), "query", "item", "score", K)


def asymmetric_rerank(spark, root):
    """The 50 nearest signs, by the query's components added where the item's bit is set and subtracted elsewhere."""
    coded = signs(spark, root)
    near = S.hamming_top_k(coded, asked_signs(spark, root), 1, 50).select("query", "item")
    own = asked(spark, root).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("projections"))
    scored = P.asymmetric_scores(near.join(coded.withColumnRenamed("id", "item"), "item"), own, WIDTH)
    return S.top_k(scored.withColumn("score", F.round("score", 6)), "query", "item", "score", K)


def pairwise_hamming_sample(spark, root):
    """The sample of 4,096 pairs."""
    made = S.pairwise_stats(signs(spark, root), 1)
    return made.select("pairs", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most")


def bit_correlation_sample(spark, root):
    """Summary of the correlations over 300 rows at even steps."""
    one = S.correlation_summary(S.bit_correlations(signs(spark, root), WIDTH, 300), WIDTH)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def variable_bands(spark, root):
    """Candidates within radius 10 over nine bands of seven and eight bits."""
    found = S.spanned_candidates(signs(spark, root), asked_signs(spark, root), S.band_spans(WIDTH, 9), 10)
    return found.groupBy("query").agg(F.count("*").alias("candidates"))


def kmeans_centers(spark, root):
    made = Q.kmeans_thresholds(embeddings(spark, root), "vec_id", "embedding", 2)
    return made.select("dim", *[F.round(F.col("centers")[k], 6).alias(f"c{k}") for k in range(3)])


#: Three centers of each dimension for the packed codes.
CENTERS = np.tile(np.array([[-0.12, 0.0, 0.12]]), (WIDTH, 1))


def packed_ternary_topk(spark, root):
    """Ternary codes, five to a byte, scored by table look-ups."""
    rows = Q.components(embeddings(spark, root), "vec_id", "embedding")
    codes = rows.select("id", "dim", F.when(F.col("x") > 0.06, 2).when(F.col("x") < -0.06, 0).otherwise(1).alias("code"))
    return Q.packed_scores(Q.packed_codes(codes, WIDTH, 3, 5), CENTERS, asked(spark, root), "vec_id", "embedding", 3, 5, K)


def weighted_hamming_topk(spark, root):
    """Bits weigh 1, 2, 1, 2, ...; the queries against all rows."""
    return P.weighted_hamming_top_k(signs(spark, root), asked_signs(spark, root), [1.0, 2.0] * 32, K)


def budgeted_probe_counts(spark, root):
    costs = asked(spark, root).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("costs"))
    return P.budgeted_candidates(signs(spark, root), asked_signs(spark, root), costs, WIDTH, 40).groupBy("query").agg(F.count("*").alias("candidates"))


def intraband_correlation(spark, root):
    made = S.bit_correlations(signs(spark, root), WIDTH, None)
    return P.intraband_correlation(made, [list(range(b * 8, b * 8 + 8)) for b in range(8)]).select("band", F.round("correlation", 6).alias("correlation"))


def balanced_band_correlation(spark, root):
    made = S.bit_correlations(signs(spark, root), WIDTH, None)
    return P.intraband_correlation(made, P.band_layout(signs(spark, root), WIDTH, 8))


def uncertainty_masks(spark, root):
    return P.masked_signatures(embeddings(spark, root), "vec_id", "embedding", WIDTH).select("id", F.col("mask")[0].alias("mask"))


def updated_aggregate_counters(spark, root):
    """Label counters without the rows divisible by 20, which are then added, and those divisible by 30 removed."""
    rows = _label_signs(spark, root)
    start = S.bit_counts(rows.where("id % 20 <> 0"), WIDTH, "label")
    changes = rows.where("id % 20 = 0").select("label", "words", F.lit(1).alias("sign")).unionByName(rows.where("id % 30 = 0").select("label", "words", F.lit(-1).alias("sign")))
    return P.updated_counters(start, changes, WIDTH, "label").select("label", "n", F.posexplode("ones").alias("bit", "ones"))


def routed_labels(spark, root):
    groups = S.aggregate_signatures(_label_signs(spark, root), WIDTH, "label", "majority")
    return P.route_groups(asked_signs(spark, root), groups, "label", 1, 3)


def stable_split(spark, root):
    return P.hash_split(embeddings(spark, root).select("vec_id"), "vec_id", "salt", 0.2).select("vec_id", "held_out")


def sparse_signature_words(spark, root):
    """Signatures of 64 hyperplanes from single components."""
    values = embeddings(spark, root).select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("index", "value"))
    return P.sparse_signatures(values, S.random_hyperplanes(64, WIDTH).rows).select("id", F.col("words")[0].alias("word"))


QUERIES = {
    "cosine_topk": _exact("cosine"),
    "dot_topk": _exact("dot"),
    "euclid_topk": _exact("euclid"),
    **{f.__name__: f for f in (cosine_same_label, vector_norms, sign_pack_words, hamming_topk, multiprobe_topk, probe_diagnostics, band_candidates, hamming_rerank_coverage, signature_buckets)},
    "aggregate_any": _aggregate("any"),
    "aggregate_all": _aggregate("all"),
    "aggregate_majority": _aggregate("majority"),
    "aggregate_threshold": _aggregate("threshold", 0.6),
    **{f.__name__: f for f in (bit_ones, code_health, bit_correlations, participation_ratio, pairwise_hamming, cosine_hamming_correlation, scalar_code_entropy, scalar_code_centers, ternary_planes, ternary_group_distance)},
    "hyperplane_topk": _encoded(lambda: S.random_hyperplanes(256, WIDTH), False),
    "hadamard_topk": _encoded(lambda: S.randomized_hadamard(256, WIDTH), False),
    "pca_topk": _encoded(lambda x: S.pca(x, WIDTH), True),
    "pair_difference_topk": _encoded(lambda x: S.pair_differences(x, 128), True),
    **{f.__name__: f for f in (itq_cascade, pq_topk, opq_topk, autoencoder_topk, pq_stored_topk, adc_rerank, asymmetric_rerank, pairwise_hamming_sample, bit_correlation_sample, variable_bands, kmeans_centers, packed_ternary_topk, weighted_hamming_topk, budgeted_probe_counts, intraband_correlation, balanced_band_correlation, uncertainty_masks, updated_aggregate_counters, routed_labels, stable_split, sparse_signature_words)},
}

BASE = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT id AS query, v AS w FROM e WHERE id % 20 = 0)"""


def _top(score: str, where: str = "true", k: int = 10) -> str:
    return f"""{BASE},
sc AS (SELECT query, id AS item, round({score}, 6) + 0 AS score FROM q, e WHERE query <> id AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc)"""


COSINE = "CASE WHEN list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(w, lambda x: x * x)) = 0 THEN 0 ELSE list_inner_product(w, v) / sqrt(list_inner_product(v, v) * list_inner_product(w, w)) END"
L2 = "-(list_inner_product(w, w) - 2 * list_inner_product(w, v) + list_inner_product(v, v))"
TAIL = " SELECT query, item, score, rank FROM r WHERE rank <= 10"
WORD = " | ".join(f"(CASE WHEN v[{i + 1}] > 0 THEN {f'{1 << i}::BIGINT' if i < 63 else '(-9223372036854775807 - 1)::BIGINT'} ELSE 0 END)" for i in range(64))
SIGNS = f"{BASE}, s AS (SELECT id, label, {WORD} AS word FROM e), a AS (SELECT id AS query, word AS qword FROM s WHERE id % 20 = 0)"
GAP = "bit_count(xor(word, qword))"
NEAR = f"{SIGNS}, d AS (SELECT query, id AS item, {GAP}::BIGINT AS distance FROM a, s WHERE query <> id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d)"
BITS = f"{SIGNS}, b AS (SELECT id, label, i AS bit, (word >> i) & 1 AS value FROM s, (SELECT unnest(range(0, 64))::INT AS i))"
BITWORD = "bit_or(CASE WHEN on_ THEN CASE WHEN bit = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << bit) END ELSE 0 END)"
HEALTH = BITS + ", p AS (SELECT bit, avg(value) AS p FROM b GROUP BY 1), h AS (SELECT bit, p, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END AS e FROM p)"
CORR = BITS + """, m AS (SELECT x.bit AS a, y.bit AS b, avg((x.value & y.value)) AS pab, avg(x.value) AS pa, avg(y.value) AS pb FROM b x JOIN b y ON x.id = y.id AND x.bit < y.bit GROUP BY ALL),
k AS (SELECT a, b, (pab - pa * pb) / sqrt(pa * (1 - pa) * pb * (1 - pb)) AS c FROM m WHERE pa > 0 AND pa < 1 AND pb > 0 AND pb < 1)"""
PROBE = f"""{SIGNS},
t AS (SELECT unnest(range(0, 8)) AS tab), o AS (SELECT unnest(range(0, 8)) AS off),
masks AS (SELECT 0 AS radius, 0::BIGINT AS mask UNION ALL SELECT 1, 1::BIGINT << off FROM o UNION ALL SELECT 2, (1::BIGINT << a.off) | (1::BIGINT << b.off) FROM o a, o b WHERE a.off < b.off),
k AS (SELECT id, tab, (word >> (tab * 8)) & 255 AS key FROM s, t),
pr AS (SELECT query, tab, xor((qword >> (tab * 8)) & 255, mask) AS key, radius FROM a, t, masks),
met AS (SELECT query, id, radius FROM pr JOIN k USING (tab, key)),
first AS (SELECT query, id, min(radius) AS radius FROM met GROUP BY ALL),
goal AS (SELECT least(count(*), 640) AS goal FROM s),
per AS (SELECT query, radius, sum(count(*)) OVER (PARTITION BY query ORDER BY radius) AS upto FROM first GROUP BY query, radius),
stop AS (SELECT query, coalesce(min(radius) FILTER (upto >= goal), 2) AS stop FROM per, goal GROUP BY query)"""
# probes in the order of what their flips cost; exact buckets first
PROBE_BUDGET = f"""{SIGNS}, t AS (SELECT unnest(range(0, 8)) AS tab), o AS (SELECT unnest(range(0, 8)) AS off),
masks AS (SELECT 0::BIGINT AS mask, []::BIGINT[] AS flips UNION ALL SELECT 1::BIGINT << off, [off] FROM o UNION ALL SELECT (1::BIGINT << a.off) | (1::BIGINT << b.off), [a.off, b.off] FROM o a, o b WHERE a.off < b.off),
k AS (SELECT id, tab, (word >> (tab * 8)) & 255 AS key FROM s, t),
pr AS (SELECT q.query, tab, xor((qword >> (tab * 8)) & 255, mask) AS key, CASE WHEN len(flips) = 0 THEN -1 ELSE list_sum(list_transform(flips, lambda f: abs(w[(tab * 8 + f + 1)::INT]))) END AS cost FROM a JOIN q USING (query), t, masks),
nu AS (SELECT *, CASE WHEN cost < 0 THEN 0 ELSE row_number() OVER (PARTITION BY query ORDER BY cost, tab, key) END AS n FROM pr),
first AS (SELECT query, id, min(n) AS n FROM nu JOIN k USING (tab, key) GROUP BY ALL),
per AS (SELECT query, n, sum(count(*)) OVER (PARTITION BY query ORDER BY n) AS upto FROM first GROUP BY query, n),
last AS (SELECT query, coalesce(min(n) FILTER (upto >= 40), max(n)) AS last FROM per GROUP BY 1)
SELECT query, count(*) AS candidates FROM first JOIN last USING (query) WHERE n <= last GROUP BY 1"""
CODES = BASE + """, x AS (SELECT id, (generate_subscripts(v, 1) - 1)::INT AS dim, unnest(v) AS x FROM e),
th AS (SELECT dim, [quantile_disc(x, 0.25), quantile_disc(x, 0.5), quantile_disc(x, 0.75)] AS t FROM x GROUP BY 1),
c AS (SELECT id, dim, x.x, len(list_filter(t, lambda y: x.x > y))::INT AS code FROM x JOIN th USING (dim))"""
TERNARY = BASE + ", " + "y AS (SELECT id, label, " + " | ".join(f"(CASE WHEN abs(v[{i + 1}]) > 0.1 THEN {f'{1 << i}::BIGINT' if i < 63 else '(-9223372036854775807 - 1)::BIGINT'} ELSE 0 END)" for i in range(64)) + " AS nonzero, " + " | ".join(f"(CASE WHEN v[{i + 1}] > 0.1 THEN {f'{1 << i}::BIGINT' if i < 63 else '(-9223372036854775807 - 1)::BIGINT'} ELSE 0 END)" for i in range(64)) + " AS sign FROM e)"



def _matrix(rows: np.ndarray, thresholds: np.ndarray | None = None) -> str:
    """A matrix as rows (bit, r, th)."""
    ths = np.zeros(len(rows)) if thresholds is None else thresholds
    values = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in r)}]::DOUBLE[], {float(t)!r}::DOUBLE)" for i, (r, t) in enumerate(zip(rows, ths)))
    return f"m AS (SELECT * FROM (VALUES {values}) t(bit, r, th))"


def _coded(rows: np.ndarray, thresholds: np.ndarray | None = None, op: str = ">") -> str:
    """CTEs that end in w: (id, word, w), the packed bits of all rows."""
    return f"""{BASE}, {_matrix(rows, thresholds)},
cb AS (SELECT id, bit, list_inner_product(v, r) {op} th AS on_ FROM e, m),
w AS (SELECT id, bit // 64 AS word, bit_or(CASE WHEN on_ THEN CASE WHEN bit % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << (bit % 64) END ELSE 0 END) AS w FROM cb GROUP BY ALL)"""


def _coded_top(rows: np.ndarray, thresholds: np.ndarray | None = None, op: str = ">", k: int = 10, tail: bool = True) -> str:
    return _coded(rows, thresholds, op) + """, d AS (SELECT a.id AS query, s.id AS item, sum(bit_count(xor(a.w, s.w)))::BIGINT AS distance FROM w a JOIN w s USING (word) WHERE a.id % 20 = 0 AND a.id <> s.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d)""" + (f" SELECT query, item, distance, rank FROM r WHERE rank <= {k}" if tail else "")


def _books_sql() -> str:
    values = ", ".join(f"({p}, {c}, [{', '.join(repr(float(x)) for x in center)}]::DOUBLE[])" for p, book in enumerate(_books()) for c, center in enumerate(book))
    return f"k AS (SELECT * FROM (VALUES {values}) t(part, center, c))"


AUTO = _weights(96, 5)
PLANES = S.random_hyperplanes(64, WIDTH).rows

SQL = {
    "hyperplane_topk": _coded_top(S.random_hyperplanes(256, WIDTH).rows),
    "hadamard_topk": _coded_top(S.randomized_hadamard(256, WIDTH).rows),
    "autoencoder_topk": _coded_top(AUTO[0], -AUTO[1], ">="),
    "sparse_signature_words": _coded(PLANES) + " SELECT id, w AS word FROM w",
    "adc_rerank": _coded_top(PLANES, tail=False) + """, pr AS (SELECT query, bit, list_inner_product(w, r) AS p FROM q, m),
sc AS (SELECT r.query, r.item, round(-sum((p - CASE WHEN on_ THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END) ** 2), 6) + 0 AS score FROM r JOIN cb ON cb.id = r.item JOIN pr ON pr.query = r.query AND pr.bit = cb.bit WHERE rank <= 50 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc) SELECT query, item, score, rank FROM z WHERE rank <= 10""",
    "asymmetric_rerank": NEAR + """, sc AS (SELECT r.query, r.item, round(list_sum(list_transform(list_zip(q.w, e.v), lambda z: CASE WHEN z[2] > 0 THEN z[1] ELSE -z[1] END)), 6) + 0 AS score FROM r JOIN q ON q.query = r.query JOIN e ON e.id = r.item WHERE rank <= 50),
z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc) SELECT query, item, score, rank FROM z WHERE rank <= 10""",
    "pq_stored_topk": f"""{BASE}, {_books_sql()},
x AS (SELECT id, part, center, list_sum(list_transform(list_zip(v[part * 8 + 1:part * 8 + 8], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, k),
code AS (SELECT id, part, arg_min(center, (d, center)) AS center FROM x GROUP BY ALL),
sc AS (SELECT x.id AS query, code.id AS item, round(sum(d), 6) + 0 AS score FROM code JOIN x USING (part, center) WHERE x.id % 20 = 0 AND x.id <> code.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, item) AS rank FROM sc) SELECT query, item, score, rank FROM r WHERE rank <= 10""",
    "pairwise_hamming_sample": SIGNS + """, o AS (SELECT word, row_number() OVER (ORDER BY id) - 1 AS no FROM s), n AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS total FROM o),
st AS (SELECT min(c) AS step FROM (SELECT unnest(range(1099511628211 % total, 1099511628211 % total + 1000)) AS c, total FROM n) WHERE c > 0 AND gcd(c, total) = 1),
ch AS (SELECT CASE WHEN total <= 4096 THEN i ELSE (1469598103934665603 % total + i * step) % total END AS r FROM n, st, range(4096) t(i) WHERE i < total),
p AS (SELECT xor(a.word, b.word) AS x, (a.no * (2 * n - a.no - 1)) // 2 + b.no - a.no - 1 AS r FROM o a JOIN o b ON a.no < b.no, n),
d AS (SELECT bit_count(x) AS d FROM p JOIN ch USING (r)) SELECT count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS deviation, min(d)::BIGINT AS least, max(d)::BIGINT AS most FROM d""",
    "bit_correlation_sample": SIGNS + """, o AS (SELECT id, word, row_number() OVER (ORDER BY id) - 1 AS no, count(*) OVER () AS n FROM s), t AS (SELECT unnest(range(300)) AS i),
pick AS (SELECT id, word FROM o JOIN t ON no = i * n // least(n, 300) WHERE i < n),
b AS (SELECT id, i AS bit, (word >> i) & 1 AS value FROM pick, (SELECT unnest(range(0, 64))::INT AS i)),
m AS (SELECT x.bit AS a, y.bit AS b, avg((x.value & y.value)) AS pab, avg(x.value) AS pa, avg(y.value) AS pb FROM b x JOIN b y ON x.id = y.id AND x.bit < y.bit GROUP BY ALL),
k AS (SELECT abs((pab - pa * pb) / sqrt(pa * (1 - pa) * pb * (1 - pb))) AS c FROM m WHERE pa > 0 AND pa < 1 AND pb > 0 AND pb < 1), l AS (SELECT list_sort(list(c)) AS l, avg(c) AS mean FROM k)
SELECT round(mean, 6) AS mean, round(l[floor(0.95 * (len(l) - 1))::INT + 1], 6) AS p95, round(l[floor(0.99 * (len(l) - 1))::INT + 1], 6) AS p99, round(l[len(l)], 6) AS largest FROM l""",
    "variable_bands": SIGNS + """, sp AS (SELECT b AS band, CASE WHEN b = 0 THEN 0 ELSE 8 + (b - 1) * 7 END AS lo, CASE WHEN b = 0 THEN 8 ELSE 7 END AS width FROM range(9) t(b)),
c AS (SELECT DISTINCT query, s.id FROM a, s, sp WHERE query <> s.id AND bit_count(((xor(word, qword) >> lo) & ((1::BIGINT << width) - 1))::BIGINT) <= CASE WHEN band <= 1 THEN 1 ELSE 0 END)
SELECT query, count(*) AS candidates FROM c GROUP BY 1""",
    "kmeans_centers": BASE + """, x AS (SELECT (generate_subscripts(v, 1) - 1)::INT AS dim, unnest(v) AS x FROM e),
c0 AS (SELECT dim, [quantile_cont(x, 1 / 6::DOUBLE), quantile_cont(x, 0.5), quantile_cont(x, 5 / 6::DOUBLE)] AS c FROM x GROUP BY 1),"""
    + ",".join(f"""
n{k} AS (SELECT dim, c, x, CASE WHEN abs(x - c[1]) <= abs(x - c[2]) AND abs(x - c[1]) <= abs(x - c[3]) THEN 1 WHEN abs(x - c[2]) <= abs(x - c[3]) THEN 2 ELSE 3 END AS own FROM x JOIN c{k} USING (dim)),
c{k + 1} AS (SELECT dim, [coalesce(avg(x) FILTER (own = 1), any_value(c[1])), coalesce(avg(x) FILTER (own = 2), any_value(c[2])), coalesce(avg(x) FILTER (own = 3), any_value(c[3]))] AS c FROM n{k} GROUP BY 1)""" for k in range(2))
    + " SELECT dim, round(c[1], 6) AS c0, round(c[2], 6) AS c1, round(c[3], 6) AS c2 FROM c2",
    "packed_ternary_topk": _top("list_sum(list_transform(list_zip(w, v), lambda z: z[1] * CASE WHEN z[2] > 0.06 THEN 0.12 WHEN z[2] < -0.06 THEN -0.12 ELSE 0 END))") + TAIL,
    "budgeted_probe_counts": PROBE_BUDGET,
    "cosine_topk": _top(COSINE) + TAIL,
    "dot_topk": _top("list_inner_product(w, v)") + TAIL,
    "euclid_topk": _top(L2) + TAIL,
    "cosine_same_label": _top(COSINE, "label = 3") + TAIL,
    "vector_norms": BASE + " SELECT id AS vec_id, len(v) = 64 AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AS usable, round(list_inner_product(v, v), 6) AS squared_norm, round(list_inner_product(v[1:32], v[33:64]), 6) AS half_dot, round(-list_sum(list_transform(list_zip(v[1:32], v[33:64]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS half_l2 FROM e",
    "sign_pack_words": SIGNS + " SELECT id, word FROM s",
    "hamming_topk": NEAR + " SELECT query, item, distance, rank FROM r WHERE rank <= 10",
    "multiprobe_topk": PROBE + f", d AS (SELECT query, id AS item, {GAP}::BIGINT AS distance FROM first JOIN stop USING (query) JOIN s USING (id) JOIN a USING (query) WHERE radius <= stop AND query <> id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d) SELECT query, item, distance, rank FROM r WHERE rank <= 10",
    "probe_diagnostics": PROBE + " SELECT query, CASE stop WHEN 0 THEN 8 WHEN 1 THEN 72 ELSE 296 END::BIGINT AS buckets, count(*) AS postings, count(DISTINCT id) AS candidates FROM met JOIN stop USING (query) WHERE radius <= stop GROUP BY query, stop",
    "band_candidates": SIGNS + f""", t AS (SELECT unnest(range(0, 8)) AS band),
c AS (SELECT DISTINCT query, s.id, {GAP} AS gap FROM a, s, t WHERE query <> s.id AND bit_count(((xor(word, qword) >> (band * 8)) & 255)::BIGINT) <= CASE WHEN band <= 4 THEN 1 ELSE 0 END)
SELECT query, count(*) AS candidates, count(*) FILTER (gap <= 12) AS near FROM c GROUP BY 1""",
    "hamming_rerank_coverage": NEAR + f", sc AS (SELECT query, id AS item, round({COSINE}, 6) + 0 AS score FROM q, e WHERE query <> id), x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS p FROM sc) SELECT x.query, round(count(r.item) / 10, 6) AS coverage FROM x LEFT JOIN r ON r.query = x.query AND r.item = x.item AND r.rank <= 100 WHERE p <= 10 GROUP BY 1",
    "signature_buckets": SIGNS + " SELECT size, count(*) AS buckets FROM (SELECT word, count(*) AS size FROM s GROUP BY 1) GROUP BY 1",
    "aggregate_any": SIGNS + " SELECT label, bit_or(word) AS word FROM s GROUP BY 1",
    "aggregate_all": SIGNS + " SELECT label, bit_and(word) AS word FROM s GROUP BY 1",
    "aggregate_majority": BITS + f", g AS (SELECT label, bit, sum(value) >= ceil(count(*) * 0.5) AS on_ FROM b GROUP BY ALL) SELECT label, {BITWORD} AS word FROM g GROUP BY 1",
    "aggregate_threshold": BITS + f", g AS (SELECT label, bit, sum(value) >= ceil(count(*) * 0.6::DOUBLE) AS on_ FROM b GROUP BY ALL) SELECT label, {BITWORD} AS word FROM g GROUP BY 1",
    "bit_ones": BITS + " SELECT bit, round(avg(value), 6) AS fraction FROM b GROUP BY 1",
    "code_health": HEALTH + " SELECT round(avg((p <= 0 OR p >= 1)::INT), 6) AS constant_fraction, round(sum(e), 6) AS entropy_total, round(avg(e), 6) AS entropy_mean, round(min(e), 6) AS entropy_min, round(max(e), 6) AS entropy_max, " + ", ".join(f"round(list_sort(list(e))[{int(f * 63) + 1}], 6) AS entropy_p{int(f * 100):02d}" for f in (0.05, 0.5, 0.95)) + " FROM h",
    "bit_correlations": CORR + " SELECT a::BIGINT AS a, b::BIGINT AS b, round(c, 6) AS correlation FROM k",
    "participation_ratio": CORR + ", n AS (SELECT (1 + sqrt(1 + 8 * count(*))) / 2 AS n, sum(c * c) AS f FROM k) SELECT round(n * n / (n + 2 * f), 4) AS ratio FROM n",
    "pairwise_hamming": SIGNS + ", d AS (SELECT bit_count(xor(x.word, y.word)) AS d FROM s x JOIN s y ON x.id < y.id) SELECT count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS deviation, min(d)::BIGINT AS least, max(d)::BIGINT AS most FROM d",
    "cosine_hamming_correlation": f"{SIGNS} SELECT round(corr({COSINE}, -{GAP}), 6) AS pearson FROM q JOIN a USING (query), e JOIN s USING (id) WHERE query <> e.id",
    "scalar_code_entropy": CODES + ", n AS (SELECT dim, code, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT dim, n / sum(n) OVER (PARTITION BY dim) AS p FROM n) SELECT dim, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
    "scalar_code_centers": CODES + " SELECT dim, code, round(avg(x), 6) AS center, count(*) AS n FROM c GROUP BY ALL",
    "weighted_hamming_topk": SIGNS + """, c AS (SELECT query, id AS item, xor(word, qword) AS x FROM a, s WHERE query <> id),
sc AS (SELECT query, item, round(-(bit_count(x & 6148914691236517205) * (2 / 3::DOUBLE) + bit_count(x & -6148914691236517206) * (4 / 3::DOUBLE)), 6) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc) SELECT query, item, score, rank FROM r WHERE rank <= 10""",
    "intraband_correlation": CORR + " SELECT (a // 8)::INT AS band, round(avg(abs(c)), 6) AS correlation FROM k WHERE a // 8 = b // 8 GROUP BY 1",
    "uncertainty_masks": BASE + ", x AS (SELECT id, generate_subscripts(v, 1) - 1 AS bit, unnest(v) AS x FROM e), u AS (SELECT bit, quantile_disc(abs(x), 0.5) AS cut FROM x GROUP BY 1), g AS (SELECT id, bit, abs(x) > cut AS on_ FROM x JOIN u USING (bit)) SELECT id, " + BITWORD + " AS mask FROM g GROUP BY 1",
    "updated_aggregate_counters": BITS + " SELECT label, count(*) AS n, bit, sum(value)::BIGINT AS ones FROM b WHERE id % 30 <> 0 OR (id % 20 <> 0 AND id % 30 <> 0) GROUP BY label, bit",
    "routed_labels": BITS + f", g AS (SELECT label, bit, sum(value) >= ceil(count(*) * 0.5) AS on_ FROM b GROUP BY ALL), l AS (SELECT label, {BITWORD} AS w FROM g GROUP BY 1), d AS (SELECT query, label, bit_count(xor(w, qword))::BIGINT AS distance FROM a, l) SELECT query, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, label) AS r FROM d) WHERE r <= 3",
    "stable_split": "SELECT vec_id, ('0x' || sha256('salt' || chr(0) || vec_id)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held_out FROM embeddings",
    "ternary_planes": TERNARY + " SELECT id, nonzero, sign FROM y",
    "ternary_group_distance": TERNARY + " SELECT a.id, b.label, round(avg(bit_count(xor(a.nonzero, b.nonzero)) + 2 * bit_count(a.nonzero & b.nonzero & xor(a.sign, b.sign))), 6) AS distance FROM y a, y b WHERE a.id % 20 = 0 GROUP BY ALL",
}
