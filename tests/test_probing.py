from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions.offsets import located, token_offsets
from siltstone.operators import probing as P
from siltstone.operators import signatures as S


def data(spark, n=120):
    x = np.random.default_rng(9).normal(size=(n, 64)).astype("f4")
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>")


def test_budgeted_probes_equal_the_sequential_rule(spark):
    x, df = data(spark)
    signs = S.sign_signatures(df, "id", "e", 64)
    costs = df.where("id < 3").select("id", F.transform("e", lambda v: F.abs(v.cast("double"))).alias("costs"))
    got = {}
    for r in P.budgeted_candidates(signs, signs.where("id < 3"), costs, 64, 20).collect():
        got.setdefault(r["query"], set()).add(r["item"])
    bits = (x > 0).astype(int)
    key = lambda i, t: sum(int(bits[i, t * 8 + o]) << o for o in range(8))
    for q in range(3):
        probes = []
        for t in range(8):
            for r in range(3):
                for flips in combinations(range(8), r):
                    cost = sum(abs(float(x[q, t * 8 + o])) for o in flips) if flips else -1.0
                    probes.append((cost, t, key(q, t) ^ sum(1 << o for o in flips)))
        seen = set()
        for cost, t, k in sorted(probes):
            if cost >= 0 and len(seen) >= 20:
                break
            seen |= {i for i in range(len(x)) if key(i, t) == k}
        assert got[q] == seen


def test_asymmetric_scores(spark):
    c = spark.createDataFrame([(1, 2, [5])], "query long, item long, words array<long>")
    p = spark.createDataFrame([(1, [0.5, 2.0, -1.0])], "id long, projections array<double>")
    assert P.asymmetric_scores(c, p, 3).first()["score"] == 0.5 - 2.0 - 1.0


def test_weighted_hamming_ranks_all_rows(spark, small):
    from siltstone.plans import vector_queries as V

    e = V.embeddings(spark, small).select("vec_id", "embedding").collect()
    ids, bits = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e]) > 0
    weights = np.array([1.0, 2.0] * 32) / 1.5
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.round(-((bits != bits[q]) @ weights), 6)
        score[q] = -np.inf
        want |= {(int(ids[q]), int(ids[i]), float(score[i]), n + 1) for n, i in enumerate(np.lexsort((ids, -score))[:10])}
    assert {(r["query"], r["item"], r["score"], r["rank"]) for r in V.weighted_hamming_topk(spark, small).collect()} == want
    several = P.weighted_hamming_top_k(V.signs(spark, small).repartition(3), V.asked_signs(spark, small).repartition(2), [1.0, 2.0] * 32, 10, tile=50)
    assert {(r["query"], r["item"], r["score"], r["rank"]) for r in several.collect()} == want


def test_masked_distance_ignores_unsure_bits(spark):
    df = spark.createDataFrame([([7], [0], [3], [5])], "a array<long>, b array<long>, ma array<long>, mb array<long>")
    assert df.select(P.masked_distance(F.col("a"), F.col("b"), F.col("ma"), F.col("mb"), 1)).first()[0] == 1


def test_hash_split_is_stable_and_near_its_share(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    a = P.hash_split(rows, "k", "s", 0.25).where("held_out").count()
    assert 900 < a < 1100 and a == P.hash_split(rows.repartition(7), "k", "s", 0.25).where("held_out").count()


def test_layout_uses_every_bit_once(spark):
    _, df = data(spark)
    layout = P.band_layout(S.sign_signatures(df, "id", "e", 64), 64, 8)
    assert sorted(i for own in layout for i in own) == list(range(64)) and {len(own) for own in layout} == {8}


def test_layout_rests_on_all_rows(spark):
    x, df = data(spark, 900)
    bits = (x > 0).astype(float)
    p = bits.mean(0)
    h = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    c = abs(np.corrcoef(bits.T))
    want = [[] for _ in range(8)]
    for i in np.argsort(-h, kind="stable"):
        best = min((b for b in range(8) if len(want[b]) < 8), key=lambda b: (c[i, want[b]].mean() if want[b] else 0.0, len(want[b]), b))
        want[best].append(int(i))
    assert P.band_layout(S.sign_signatures(df, "id", "e", 64), 64, 8) == want


def test_offsets_count_bytes(spark):
    assert located("Foo, 3.5!", symbols=True) == [("foo", 0, 3, "word"), (",", 3, 4, "symbol"), ("3.5", 5, 8, "number"), ("!", 8, 9, "symbol")]
    df = spark.createDataFrame([(1, "é ab"), (2, None), (3, "")], "d long, t string")
    assert [(r["token"], r["byte_offset"], r["byte_length"]) for r in token_offsets(df, "d", "t").orderBy("position").collect()] == [("é", 0, 2), ("ab", 3, 2)]
