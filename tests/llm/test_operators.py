import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fusion
from siltstone.llm.distinctive import current_records, distinctive_terms
from siltstone.llm.frequency import current_postings, term_frequencies
from siltstone.llm.mixing import _settle, default_total, mix, rake, rake_table
from siltstone.llm.neighbours import current_vectors, hilbert_keys, nearest
from siltstone.llm.packing import Plan, pack
from siltstone.llm.splitting import split_oversized
from siltstone.llm.topn import top_n_per_group

NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- 2


def test_top_n_equals_brute_force(spark):
    rng = random.Random(5)
    hits = [(f"q{rng.choice([0] * 9 + [1, 2, 3])}", f"c{rng.randrange(400)}", rng.choice([0.5, 1.0, rng.random()])) for _ in range(5000)]
    df = spark.createDataFrame([(*h, "x", 1) for h in hits], "query_id string, chunk_id string, score float, g string, place int").repartition(7)
    limits = spark.createDataFrame([("q0", 25), ("q0", 3), ("q1", None), ("q2", 0), ("q3", 4), ("none", 5), (None, 9)], "query_id string, hit_limit long")
    best = defaultdict(dict)
    for q, c, s in hits:
        s = float(np.float32(s))
        best[q][c] = max(best[q].get(c, -9), s)
    want = {(q, c) for q, n in {"q0": 25, "q1": 10, "q3": 4}.items() for c, _ in sorted(best[q].items(), key=lambda x: (-x[1], x[0]))[:n]}
    got = top_n_per_group(df, limits)
    assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want
    assert sorted(r["place"] for r in got.where("query_id = 'q3'").collect()) == [1, 2, 3, 4]


def test_one_large_limit_leaves_other_heaps_small(spark):
    from siltstone.llm import topn

    hits = spark.createDataFrame([(f"q{i % 50}", f"c{i:05d}", float(i)) for i in range(5000)], "query_id string, chunk_id string, score double")
    limits = spark.createDataFrame([("q0", 1_000_000), *[(f"q{i}", 2) for i in range(1, 40)]], "query_id string, hit_limit long")
    sizes = topn.bucket_limits(limits.selectExpr("query_id as g", "hit_limit as n"))
    assert sorted(np.unique(sizes)) == [0, 2, 1_000_000] and (sizes == 1_000_000).sum() == 1
    got = top_n_per_group(hits, limits).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {"q0": 100, **{f"q{i}": 2 for i in range(1, 40)}}


def test_top_n_edge_rows(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "a", 1.0), ("q", "n", NAN), ("q", None, 3.0), (None, "x", 3.0), ("q", "z", None), ("q", "m", -0.0), ("q", "l", 0.0)], "query_id string, chunk_id string, score double")
    limits = spark.createDataFrame([("q", 3)], "query_id string, hit_limit long")
    assert [r["chunk_id"] for r in top_n_per_group(df, limits).orderBy("place").collect()] == ["a", "b", "l"]
    assert top_n_per_group(df.limit(0), limits).count() == 0 and top_n_per_group(df, limits.limit(0)).count() == 0


# ---- 3


def test_hilbert_neighbours_are_neighbouring_cells():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_nearest_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(150, 16))
    x = (np.repeat(centers, 12, 0) + 0.15 * rng.normal(size=(1800, 16))).astype("f4")
    data = [(f"c{i:05d}", [float(v) for v in r], 1) for i, r in enumerate(x)]
    data += [(f"d{i}", data[0][1], 1) for i in range(40)]
    data += [("null", None, 1), ("short", [1.0], 1), ("zero", [0.0] * 16, 1), ("nan", [NAN] * 16, 1), (None, data[3][1], 1), ("inf", [float("inf")] * 16, 1)]
    df = spark.createDataFrame(data, "chunk_id string, embedding array<float>, place int")
    got = defaultdict(list)
    for r in nearest(df, width=16).orderBy("place").collect():
        got[r["chunk_id"]].append(r["other"])
    assert set(got) == {f"c{i:05d}" for i in range(1800)} | {f"d{i}" for i in range(40)}
    full = np.concatenate([x, np.repeat(x[:1], 40, 0)]).astype(float)
    names = [f"c{i:05d}" for i in range(1800)] + [f"d{i}" for i in range(40)]
    unit = full / np.linalg.norm(full, axis=1)[:, None]
    hit = all_ = 0
    for i in range(1, 1800, 20):
        s = np.round(unit @ unit[i], 10)
        s[i] = -9
        order = sorted(range(len(s)), key=lambda j: (-s[j], names[j]))[:5]
        hit += len({names[j] for j in order} & set(got[names[i]]))
        all_ += 5
    assert hit / all_ >= 0.98
    assert got["d7"] == ["c00000", "d0", "d1", "d10", "d11"]  # copies by id, byte by byte
    assert nearest(df.limit(0), width=16).count() == 0


def test_current_vectors(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("a", 2, [2.0]), (None, 3, [1.0]), ("b", None, [5.0])], "chunk_id string, generation long, embedding array<float>")
    assert rows(current_vectors(df)) == [("a", [2.0]), ("b", [5.0])]


# ---- 4


@pytest.mark.parametrize("kind", ["long", "string"])
def test_frequencies_equal_brute_force(spark, kind):
    rng = random.Random(2)
    data = [((t := rng.randrange(1, 300)) if kind == "long" else f"t{t}" if (t := rng.randrange(1, 300)) else "", f"r{rng.randrange(90)}", rng.randrange(0, 4)) for _ in range(4000)]
    data += [(1 if kind == "long" else "t1", f"r{i}", 2) for i in range(90)]
    best = {}
    for t, r, n in data:
        if n >= 1:
            best[t, r] = max(n, best.get((t, r), 0))
    seen, records = defaultdict(int), defaultdict(int)
    for (t, _), n in best.items():
        seen[t] += n
        records[t] += 1
    df = spark.createDataFrame(data + [(None, "r", 1), (data[0][0], None, 1), (data[0][0], "r1", None)], f"t {kind}, r string, n int").withColumn("seen", F.lit("clash"))
    got = term_frequencies(df, "t", "r", "n").orderBy("term_code").collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == {t: (seen[t], records[t]) for t in seen}
    assert [r["term_code"] for r in got] == list(range(len(seen))) and [r["term"] for r in got] == sorted(seen)
    assert all(r["mark"] == ("rare" if r["records"] < 3 else "common" if r["records"] > r["all_records"] / 4 else None) for r in got)
    assert term_frequencies(df.limit(0), "t", "r", "n").count() == 0


def test_current_postings_count_generations_of_all_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 2, 3), (1, "a", 2, 3), (2, "a", 1, 9), (None, "b", 5, 1), (3, "b", 4, 1), (4, None, 1, 1)], "token_id long, chunk_id string, generation long, term_frequency int")
    assert rows(current_postings(df).where("token_id is not null")) == [(1, "a", 3)]


# ---- 5


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_their_text(spark, seed):
    rng = random.Random(seed)
    alphabet = ["word ", "длинное ", "句子。", "x" * 90, "\n\n", "a. ", "🙂", "\n", "é́ "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(12)] + ["", None, "y" * 5000, "🙂" * 900, "short", "short"]
    df = spark.createDataFrame([(i, t, i * 10) for i, t in enumerate(texts)], "id long, text string, start long").withColumn("piece", F.lit("clash"))
    found = defaultdict(list)
    for r in split_oversized(df, "id", limit=240, overlap=24, offset="start").orderBy("id", "piece").collect():
        found[r["id"]].append(r)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in found
            continue
        data, at = t.encode(), i * 10
        pieces = found[i]
        for p in pieces:
            a, n = p["source_range"]
            assert n <= 240 and data[a - at : a - at + n].decode() == p["text"] and p["piece_count"] == len(pieces)
        end = 0
        for k, p in enumerate(pieces):
            a, n = p["source_range"][0] - at, p["source_range"][1]
            if k:
                assert 0 <= 24 - (end - a) <= 3
            end = a + n
        assert end == len(data)


def test_cuts_prefer_strong_boundaries(spark):
    text = "a b c d e f. " * 6 + "\n\n" + "g h i j k l. " * 6
    df = spark.createDataFrame([("x", text)], "id string, text string")
    pieces = split_oversized(df, "id", limit=100, overlap=0).orderBy("piece").collect()
    assert [p["text"].strip()[0] for p in pieces] == ["a", "g"] and not any(p["hard"] for p in pieces)
    hard = split_oversized(spark.createDataFrame([("x", "z" * 300)], "id string, text string"), "id", limit=100, overlap=10)
    assert hard.where("hard").count() == hard.count() - 1 and hard.first()["unbroken"]
    with pytest.raises(ValueError):
        split_oversized(df, "id", limit=10, overlap=8)


# ---- 6


def brute_flow(scores):
    n = len(scores)
    x = {i: (sum(s < v for s in scores.values()) + sum(s <= v for s in scores.values())) / 2 / n for i, v in scores.items()}
    p = lambda d: min(1.0, max(0.0, (d - fusion.INDIFFERENT) / (fusion.STRICT - fusion.INDIFFERENT)))
    return {i: sum(p(x[i] - x[j]) - p(x[j] - x[i]) for j in x) / max(1, n - 1) for i in x}


def test_fusion_equals_brute_force_on_both_paths(spark):
    rng = random.Random(3)
    a = [("q" if rng.random() < 0.7 else "r", f"c{rng.randrange(60)}", round(rng.gauss(0, 100), 0)) for _ in range(150)]
    b = [("q" if rng.random() < 0.7 else "r", f"c{rng.randrange(60)}", rng.randrange(9)) for _ in range(120)]
    da = spark.createDataFrame([*a, ("q", None, 1.0), (None, "c", 1.0), ("q", "nan", NAN), ("q", "null", None)], "query_id string, chunk_id string, score double").withColumn("flow", F.lit(0))
    db = spark.createDataFrame(b, "query_id string, chunk_id string, hamming_distance int")
    want = {}
    for q in "qr":
        one, two = {}, {}
        for x, c, s in a:
            if x == q:
                one[c] = max(s, one.get(c, -1e9))
        for x, c, s in b:
            if x == q:
                two[c] = max(-s, two.get(c, -1e9))
        fa, fb = brute_flow(one), brute_flow(two)
        for c in one.keys() | two.keys():
            want[q, c] = (fa.get(c, 0) + fb.get(c, 0)) / 2
    for large in (10**6, 5):
        got = fusion.fused_ranking([(da, "score", True), (db, "hamming_distance", False)], large_group=large).collect()
        assert {(r["query_id"], r["chunk_id"]) for r in got} == set(want)
        assert all(math.isclose(r["flow"], want[r["query_id"], r["chunk_id"]], abs_tol=1e-9) for r in got), large
        for q in "qr":
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])
            assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
            assert [(-round(r["flow"], 9), r["chunk_id"]) for r in mine] == sorted((-round(r["flow"], 9), r["chunk_id"]) for r in mine)
            assert sorted(r["place_1"] for r in mine if r["place_1"] and r["place_1"] <= 5) == [1, 2, 3, 4, 5]
    empty = fusion.fused_ranking([(da.limit(0), "score", True), (db.limit(0), "hamming_distance", False)])
    assert empty.count() == 0


def test_fusion_places_are_the_same_on_both_paths(spark):
    rng = random.Random(4)
    a = [(rng.choice("qqr"), f"c{rng.randrange(60)}", float(rng.randrange(30))) for _ in range(150)]
    b = [(rng.choice("qqr"), f"c{rng.randrange(60)}", rng.randrange(9)) for _ in range(120)]
    da = spark.createDataFrame([*a, ("q", "nan", NAN)], "query_id string, chunk_id string, score double")
    db = spark.createDataFrame(b, "query_id string, chunk_id string, hamming_distance int")
    want = {}
    for k, (hits, sign) in enumerate(((a, 1), (b, -1))):
        for q in "qr":
            best = {}
            for x, c, s in hits:
                if x == q:
                    best[c] = max(sign * s, best.get(c, -1e9))
            want |= {(k, q, c): n for n, (_, c) in enumerate(sorted((-s, c) for c, s in best.items()), 1)}
    assert max(want.values()) > 5
    for large in (10**6, 5):
        got = fusion.fused_ranking([(da, "score", True), (db, "hamming_distance", False)], large_group=large).collect()
        assert {(k, r["query_id"], r["chunk_id"]): r[f"place_{k}"] for r in got for k in (0, 1) if r[f"place_{k}"] is not None} == want, large


# ---- 7


def test_distinctive_terms(spark):
    data = [("a", ["X", "x ", "x", "y"]), ("b", ["y", "z", " ", "", None]), ("c", None), (None, ["x"]), ("d", [])]
    df = spark.createDataFrame(data, "chunk_id string, tokens array<string>").withColumn("term", F.lit("clash"))
    got = {(r["chunk_id"], r["term"]): r for r in distinctive_terms(df, min_records=1).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "y"), ("b", "z")}
    mu, p = 3.0, 3 / 6
    q = (3 + mu * p) / (4 + mu)
    assert math.isclose(got["a", "x"]["score"], q * math.log(q / p)) and got["a", "x"]["token_count"] == 4
    assert {k for k in got if got[k]["records"] >= 2} == {(r["chunk_id"], r["term"]) for r in distinctive_terms(df).collect()}
    assert distinctive_terms(df.limit(0)).count() == 0


def test_current_records(spark):
    df = spark.createDataFrame([("a", 1, ["old"]), ("a", 2, None), ("b", 1, ["x"]), ("b", 1, ["x"]), (None, 1, ["n"])], "chunk_id string, generation long, tokens array<string>")
    assert rows(current_records(df)) == [("a", None), ("b", ["x"])]


# ---- 8


def test_containers_hold_all_and_never_overflow(spark):
    rng = random.Random(4)
    sizes = [rng.choice([rng.randrange(1, 40), rng.randrange(40, 300), rng.randrange(300, 1300)]) for _ in range(3000)] + [0, 0, 1000, 1000, 1001, 2500, None, -5]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, n long").withColumn("container", F.lit(1)).repartition(3)
    got = pack(df, "id", size="n", capacity=1000).collect()
    filled, per = defaultdict(int), defaultdict(list)
    for r in got:
        filled[r["container"]] += r["size"]
        per[r["id"]].append(r)
    assert set(per) == set(range(len(sizes))) and max(filled.values()) <= 1000
    for i, s in enumerate(sizes):
        parts = sorted(per[i], key=lambda r: r["piece"])
        assert sum(r["size"] for r in parts) == max(0, s or 0) and (len(parts) > 1) == ((s or 0) > 1000)
        assert [r["size_offset"] for r in parts] == [1000 * k for k in range(len(parts))]
    assert sum(filled.values()) / (1000 * len(filled)) > 0.98 and set(filled) == set(range(len(filled)))
    other = pack(df.repartition(11), "id", size="n", capacity=1000).collect()
    assert {(r["id"], r["piece"], r["container"]) for r in got} == {(r["id"], r["piece"], r["container"]) for r in other}
    assert pack(df.limit(0), "id", size="n").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plans_hold_their_classes(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, [101, 30, 60][seed], 500))
    plan = Plan(np.bincount(sizes, minlength=101), 100)
    bins = plan.place(np.arange(500))
    filled = np.bincount(bins, weights=sizes)
    assert len(filled) == plan.bins and filled.max() <= 100
    for b in range(plan.bins - 1):
        own = sizes[bins == b]
        k = 100 // own.max()
        # as many as its class says, unless the class has no more
        assert (100 // own == k).sum() == k or not (100 // sizes[bins > b] == k).any()


def test_sizes_are_bytes_of_the_text(spark):
    df = spark.createDataFrame([("a", "é" * 10), ("b", None), ("c", ""), ("c", "")], "id string, text string")
    assert sorted((r["id"], r["size"]) for r in pack(df, "id", text="text", capacity=8).collect()) == [("a", 4), ("a", 8), ("a", 8), ("b", 0), ("c", 0), ("c", 0)]


# ---- 9


def test_raking_is_the_same_as_a_table(spark):
    rng = np.random.default_rng(8)
    cells = np.array([(s, a, t) for s in range(3) for a in range(4) for t in range(3) if rng.random() < 0.8]).T
    n = rng.integers(1, 900, cells.shape[1]).astype(float)
    goal, cap = np.array([900.0, 4000.0, 300.0]), np.array([1.0, 2.0, 3.0])
    goal = np.minimum(goal, np.bincount(cells[0], n) * cap)
    table = spark.createDataFrame([(f"s{s}", f"l{a}", f"t{t}", float(x), float(goal[s]), int(cap[s])) for s, a, t, x in zip(*cells, n)], "source string, language string, topic string, n double, goal double, cap long")
    want, change = rake(cells, n, goal, cap, 4)
    got, other = rake_table(table, 4)
    got = {(r["source"], r["language"], r["topic"]): r["copies"] for r in got.collect()}
    assert all(math.isclose(got[f"s{s}", f"l{a}", f"t{t}"], w, rel_tol=1e-9) for s, a, t, w in zip(*cells, want)) and math.isclose(change, other, rel_tol=1e-6)
    done, change = rake(cells, n, goal, cap)
    assert np.allclose(np.bincount(cells[0], done * n), goal) and (done <= cap[cells[0]] * (1 + 1e-9)).all() and change < 1e-9


def test_default_size_covers_most_targets():
    assert default_total(np.array([0.5, 0.45, 0.05, 0.0]), np.array([100.0, 180.0, 1.0, 9.0])) == 200
    assert default_total(np.array([0.5, 0.5]), np.array([0.0, 10.0])) == 20 and default_total(np.zeros(1), np.ones(1)) == 0


def test_mix_reaches_targets_within_its_caps(spark):
    docs = [(i, " Big_One " if i % 2 else "big-one", ["en", "FR", None, "de-x"][i % 4], "x" * 100) for i in range(2000)]
    docs += [(5000 + i, "small", "en", "y" * 100) for i in range(40)] + [(9000, "unlisted", "en", "z" * 900), (9001, None, "en", "z"), (9002, "small", "en", None), (9003, "small", "en", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big-one", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 9)], "source string, target_share double, max_repeats int")
    topics = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1000)], "doc_id long, topic string")
    sample, report = mix(df, targets, topics)
    got = {r["source"]: r for r in report.collect()}
    assert got["big-one"]["tokens"] == 200_000 and got["big-one"]["reachable"] and not got["small"]["reachable"] and not got["absent"]["reachable"]
    assert got["small"]["mixed_tokens"] == 16_000
    # the default size: big-one may give 400,000 for its half, small 53,333 for its share; 0.5 of 0.8 doesn't suffice
    assert got["big-one"]["goal_tokens"] == pytest.approx(0.5 * 16_000 / 0.3) and all(r["on_goal"] for r in got.values())
    assert abs(got["big-one"]["mixed_tokens"] - got["big-one"]["goal_tokens"]) <= 100
    assert abs(got["big-one"]["reached_share"] - 0.5 / 0.8) < 0.01
    large = {r["source"]: r for r in mix(df, targets, topics, total=300_000)[1].collect()}
    assert abs(large["big-one"]["mixed_tokens"] - 150_000) <= 100 and large["small"]["mixed_tokens"] == 16_000
    assert sample.count() == 2042 and sample.where("copies > 4 or (source = 'big-one' and copies > 1)").count() == 0
    assert mix(df.limit(0), targets, topics)[1].where("mixed_tokens > 0").count() == 0
    assert mix(df, targets.limit(0))[1].count() == 0


def test_what_a_cell_leaves_open_goes_on_in_the_next_batch():
    rows = [("p", "en", f"t{k}", 4.0, 0, 10) for k in range(5)] + [("q", "en", "t0", 4.0, 0, 10)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("source", "language", "topic", "wanted", "low", "high"), r)) for r in rows])
    ends = [x for b in _settle(iter([batch.slice(k, 1) for k in range(6)])) for x in b.column("end").to_pylist()]
    assert ends == [0, 10, 0, 10, 0, 0] == [x for b in _settle(iter([batch])) for x in b.column("end").to_pylist()]


def test_mix_is_the_same_for_any_number_of_cells(spark):
    df = spark.createDataFrame([(i, "pq"[i % 2], ["en", "fr", "de"][i % 3], "x" * (1 + i * 37 % 199)) for i in range(1500)], "doc_id long, source string, lang string, text string").repartition(4, "doc_id").localCheckpoint()
    targets = spark.createDataFrame([("p", 0.6, 1), ("q", 0.4, 3)], "source string, target_share double, max_repeats int")
    topics = spark.createDataFrame([(i, f"t{i % 41}") for i in range(1500)], "doc_id long, topic string")
    (few, report), (many, other) = (mix(df, targets, topics, total=90_000, driver_cells=n, rounds=2) for n in (10_000, 0))
    assert few.orderBy("doc_id").collect() == many.orderBy("doc_id").collect()
    columns = ("source", "goal_tokens", "mixed_tokens", "on_goal")
    assert report.select(*columns).orderBy("source").collect() == other.select(*columns).orderBy("source").collect()
    assert all(abs(r["mixed_tokens"] - r["goal_tokens"]) <= 100 for r in other.collect())
