import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.vector import hadamard_rows, hamming, hyperplanes, pack
from siltstone.operators import quantize as Q
from siltstone.operators import signatures as S
from siltstone.operators.vectors import exact_top_k


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(300, 64)).astype("f4")
    x[7] = 0
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>").cache()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_exact_search_equals_brute_force(rows, metric):
    x, df = rows
    got = {(r["query"], r["rank"]): (r["item"], r["score"]) for r in exact_top_k(df, df.where("id < 5"), "id", "e", 64, metric, 4).collect()}
    d = x.astype(float)
    for q in range(5):
        s = d @ d[q] if metric == "dot" else -((d - d[q]) ** 2).sum(1) if metric == "euclid" else d @ d[q] / np.where(np.linalg.norm(d, axis=1) > 0, np.linalg.norm(d, axis=1), 1) / np.linalg.norm(d[q])
        s[q] = -np.inf
        order = np.lexsort((np.arange(300), -np.round(s, 6)))[:4]
        assert [got[q, k + 1][0] for k in range(4)] == order.tolist()


def test_cosine_hamming_correlation_counts_all_pairs(spark, small, rows):
    from siltstone.operators.vectors import cosine_hamming_pearson
    from siltstone.plans import vector_queries

    def brute(ids, x, asked):
        length = np.linalg.norm(x, axis=1)
        c = x[asked] @ x.T / np.where(length > 0, length, 1) / np.where(length > 0, length, 1)[asked][:, None]
        h = -((x[asked] > 0)[:, None, :] != (x > 0)[None]).sum(2)
        other = ids[asked][:, None] != ids[None]
        return np.corrcoef(c[other], h[other])[0, 1]

    e = vector_queries.embeddings(spark, small).select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in e])
    assert abs(vector_queries.cosine_hamming_correlation(spark, small).first()["pearson"] - brute(ids, np.array([r["embedding"] for r in e], float), ids % 20 == 0)) < 1e-6
    x, df = rows
    got = cosine_hamming_pearson(df.repartition(3), df.where("id < 30").repartition(2), "id", "e", 64).first()["pearson"]
    assert abs(got - brute(np.arange(300), x.astype(float), np.arange(300) < 30)) < 1e-9
    assert cosine_hamming_pearson(df.limit(0), df, "id", "e", 64).first()["pearson"] is None


def test_packing_and_hamming(spark):
    bits = [1, 0, 1] + [0] * 60 + [1] + [1] * 6
    df = spark.createDataFrame([(bits,)], "b array<int>").select(pack(F.col("b"), 70).alias("w"))
    w = df.first()["w"]
    assert w == [5 - (1 << 63), 63]
    zero = df.withColumn("z", F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).select(hamming(F.col("w"), F.col("z"), 2)).first()[0]
    assert zero == sum(bits)


def test_seeded_matrices():
    h = hyperplanes(16, 8, 42)
    assert set(np.unique(h)) == {-1.0, 1.0} and (h == hyperplanes(16, 8, 42)).all() and (h != hyperplanes(16, 8, 43)).any()
    m = hadamard_rows(8, 8, 1)
    assert np.allclose(m @ m.T, 8 * np.eye(8))


def test_multiprobe_at_full_radius_is_exact(spark, rows):
    _, df = rows
    signs = S.sign_signatures(df, "id", "e", 64)
    flat = {(r["query"], r["rank"]): r["item"] for r in S.hamming_top_k(signs, signs.where("id < 3"), 1, 5).collect()}
    probed, seen = S.multiprobe(signs, signs.where("id < 3"), 64, 5, radius=8, least=10_000)
    assert {(r["query"], r["rank"]): r["item"] for r in probed.collect()} == flat
    assert all(r["candidates"] == 300 for r in seen.collect())


def test_bands_never_miss_within_the_radius(spark, rows):
    _, df = rows
    signs = S.sign_signatures(df, "id", "e", 64)
    w = {r["id"]: r["words"][0] & (2**64 - 1) for r in signs.collect()}
    near = {(q, i) for q in range(10) for i in w if i != q and bin(w[q] ^ w[i]).count("1") <= 20}
    got = {(r["query"], r["item"]) for r in S.band_candidates(signs, signs.where("id < 10"), 64, 8, 20).collect()}
    assert near and near <= got


def test_pairwise_distances_count_all_pairs(spark, tmp_path):
    from siltstone.plans import vector_queries

    x = np.random.default_rng(8).normal(size=(700, 64)).astype("f4")  # 244,650 pairs
    x[5] = x[3]
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.concatenate([((x[i] > 0) != (x[i + 1 :] > 0)).sum(1) for i in range(699)])
    got = vector_queries.pairwise_hamming(spark, str(tmp_path)).first()
    assert (got["pairs"], got["mean"], got["deviation"], got["least"], got["most"]) == (244_650, round(d.mean(), 6), round(d.std(), 6), 0, d.max())
    signs = vector_queries.signs(spark, str(tmp_path))
    assert S.all_pairs_stats(signs.repartition(3), 1, 100).first()["pairs"] == 244_650
    assert S.all_pairs_stats(signs.limit(1), 1).first()["pairs"] == 0


def test_aggregates_round_majority_up(spark):
    df = spark.createDataFrame([("g", [1]), ("g", [2])], "k string, words array<long>")
    word = lambda rule: S.aggregate_signatures(df, 64, "k", rule).first()["words"][0]
    assert word("any") == 3 and word("all") == 0 and word("majority") == 3


def test_encoders_and_cascade(rows):
    x, df = rows
    assert len(S.pca(x[:200].astype(float), 32).rows) == 32
    r = S.itq(x[:200].astype(float), 16).rows
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-6)
    top = S.cascade(df, df.where("id < 5"), "id", "e", S.random_hyperplanes(256, 64), 300, 299, 3)
    exact = exact_top_k(df, df.where("id < 5"), "id", "e", 64, "cosine", 3)
    assert {(r["query"], r["item"]) for r in top.where("query <> 7").collect()} == {(r["query"], r["item"]) for r in exact.collect()}


def test_product_quantizer_orders_by_reconstruction(rows):
    x, df = rows
    q = Q.ProductQuantizer(x.astype(float), parts=8, bits=4)
    codes = q.encode_raw(x.astype(float))
    d = ((q.decode(codes) - x[0]) ** 2).sum(1)
    assert np.allclose(q.tables(x[:1].astype(float))[0][np.arange(8), codes].sum(1), d, atol=1e-6)
    got = Q.pq_top_k(q.encode(df, "id", "e"), q, df.where("id = 0"), "id", "e", 5).orderBy("rank").collect()
    d[0] = np.inf
    assert [r["item"] for r in got] == np.lexsort((np.arange(300), np.round(d, 6)))[:5].tolist()
