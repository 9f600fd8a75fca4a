import json

from siltstone.operators import ingest as I
from siltstone.operators.evaluation import dataset_problems
from siltstone.sources import datasets
from siltstone.sources.store import VersionedStore
from siltstone.sources.synthetic import clustered_vectors, lexical_dataset, noisy_queries, random_vectors, stub_dataset, stub_run
from siltstone.streaming.upserts import upsert_stream


def test_upsert_refuses_stale_generations(spark):
    active = spark.createDataFrame([("a", 2, "old"), ("b", 5, "old")], "k string, generation int, v string")
    new = spark.createDataFrame([("a", 3, "new"), ("b", 4, "new"), ("c", 1, "new"), ("c", 1, "new")], "k string, generation int, v string")
    rows = sorted(tuple(r) for r in I.upsert(active, new.distinct(), "k").collect())
    assert rows == [("a", 3, "new"), ("b", 5, "old"), ("c", 1, "new")]


def test_replay_is_idempotent_or_a_conflict(spark):
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "k string, generation int, v string")
    b = spark.createDataFrame([("a", 1, "y"), ("b", 1, None)], "k string, generation int, v string")
    assert {r["k"]: r["conflict"] for r in I.replay_conflicts(a, b, "k", ["v"]).collect()} == {"a": 1, "b": 0}


def test_manifest_diff(spark):
    old, new = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r["id"]: r["action"] for r in I.manifest_diff(old, new, ["id"]).collect()} == {"a": "reclaim", "b": "retain", "c": "insert"}


def test_store_moves_its_pointer_last(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    store.upsert("t", spark.createDataFrame([("a", 1)], "k string, generation int"), "k")
    before = store.read("t")
    store.upsert("t", spark.createDataFrame([("a", 2), ("b", 1)], "k string, generation int"), "k")
    assert before.count() == 1 and sorted(map(tuple, store.read("t").collect())) == [("a", 2), ("b", 1)]
    first, second = "a", "b"
    store.upsert("t", spark.createDataFrame([(first, 3)], "k string, generation int"), "k")
    assert store.version("t") == 3 and store.read("t", 1).count() == 1 and store.find("t", k=second).count() == 1
    assert store.vacuum("t") >= 1 and store.find("t", k="a").first()["generation"] == 3 and store.read("t").count() == 2
    store.erase("t", spark.createDataFrame([("a",)], "k string"), "k")
    assert [r["k"] for r in store.read("t").collect()] == ["b"]


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), 8)
    store.upsert("t", spark.range(100).selectExpr("cast(id as string) as k", "1 as generation"), "k")
    before = store._current("t")["parts"]
    store.upsert("t", spark.createDataFrame([("7", 2)], "k string, generation int"), "k")
    after = store._current("t")["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("t").count() == 100
    store.upsert("t", spark.createDataFrame([("7", 1)], "k string, generation int"), "k")
    assert store.find("t", k="7").first()["generation"] == 2


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), 4)
    store.write("t", spark.createDataFrame([("a", 1)], "k string, generation int"), "k")
    broken = spark.range(3).selectExpr("raise_error('no') as k", "1 as generation")
    try:
        store.write("t", broken, "k")
        raise AssertionError("the write must fail")
    except Exception as e:
        assert "no" in str(e)
    assert store.version("t") == 1 and store.read("t").count() == 1


def test_manifests_of_all_versions(spark, tmp_path):
    from siltstone.sources.manifests import CURRENT, ManifestStore, current_payload, manifest_problems

    rec = lambda c, o: [(k, c, o) for k in ("chunk", "embedding", "vector_record")]
    kind = "array<struct<kind: string, chunk_id: string, ordinal: int>>"
    rows = spark.createDataFrame([("a", 1, rec("c1", 0) + rec("c2", 1), rec("x", 4), "f" * 64, 9, "s", 2, 5), ("b", 1, rec("c1", 1), rec("x", 4), "f" * 64, 9, "s", 2, 2)], f"resource_id string, generation long, records {kind}, pending_reclaim {kind}, body_digest string, pipeline_hash long, schema_id string, schema_version int, payload_version int")
    got = {r["resource_id"]: r for r in current_payload(rows).collect()}
    assert got["a"]["schema_id"] == "s" and got["b"]["schema_id"] == "" and got["b"]["body_digest"] is None and len(got["b"]["pending_reclaim"]) == 3
    wrong = {(r["resource_id"], r["problem"]) for r in manifest_problems(current_payload(rows), "s").collect()}
    assert wrong == {("b", p) for p in ("payload to be migrated", "foreign schema", "digest missing", "pipeline hash missing", "records out of order")}
    store = ManifestStore(spark, str(tmp_path))
    store.upsert(rows)
    assert store.find("b").first()["payload_version"] == CURRENT
    for _ in range(2):
        store.drain(spark.createDataFrame([("a", "x", "chunk"), ("a", "x", "embedding")], "resource_id string, chunk_id string, kind string"))
        assert [r["kind"] for r in store.find("a").first()["pending_reclaim"]] == ["vector_record"]
    store.erase(spark.createDataFrame([("a",)], "resource_id string"))
    assert store.find("a").count() == 0 and store.find("b").count() == 1


def test_owners_are_not_taken_over(spark, tmp_path):
    from siltstone.sources.manifests import OwnerStore

    store = OwnerStore(spark, str(tmp_path))
    schema = "record_key string, kind string, resource_id string, generation long"
    store.claim(spark.createDataFrame([("c1", "chunk", "r1", 1)], schema))
    store.claim(spark.createDataFrame([("c1", "chunk", "r2", 9), ("c2", "chunk", "r2", 1)], schema))
    assert store.owner("c1").first()["resource_id"] == "r1" and store.owner("c2").first()["resource_id"] == "r2"
    store.release(spark.createDataFrame([("r1",)], "resource_id string"))
    assert store.owner("c1").count() == 0


def test_matrices_with_ids(spark, tmp_path):
    import numpy as np
    import pytest

    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m.f32").write_bytes(x.tobytes())
    (tmp_path / "ids").write_text("d\nc\nb\na\n")
    got = {r["id"]: r["embedding"] for r in datasets.load_matrix(spark, str(tmp_path / "ids"), str(tmp_path / "m.f32"), 3).collect()}
    assert got["d"] == [0, 1, 2] and got["a"] == [9, 10, 11]
    for width, digest in ((5, None), (2, None), (3, "0" * 64)):
        with pytest.raises(ValueError):
            datasets.load_matrix(spark, str(tmp_path / "ids"), str(tmp_path / "m.f32"), width, digest)
    (tmp_path / "q").write_text("q1\td\t1\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"dimension": 3, "documents": {"ids": "ids", "matrix": "m.f32"}, "queries": {"ids": "qids", "matrix": "q.f32"}, "qrels": "q"}))
    (tmp_path / "qids").write_text("q1\n")
    (tmp_path / "q.f32").write_bytes(x[:1].tobytes())
    assert datasets.load_materialized(spark, str(tmp_path))["qrels"].count() == 1
    (tmp_path / "q").write_text("q1\tzz\t1\n")
    with pytest.raises(ValueError):
        datasets.load_materialized(spark, str(tmp_path))


def test_encoders_come_back_as_saved(spark, tmp_path):
    import numpy as np
    import pytest

    from siltstone.operators.signatures import autoencoder

    rng = np.random.default_rng(0)
    one = autoencoder(rng.normal(size=(70, 5)).astype("f4"), rng.normal(size=70).astype("f4"))
    w, m = str(tmp_path / "w"), str(tmp_path / "m")
    datasets.save_encoder(one, w, m)
    x = rng.normal(size=(9, 5))
    assert (datasets.load_encoder(w, m).words(x) == one.words(x)).all()
    open(w, "ab").write(b"1234")
    with pytest.raises(ValueError):
        datasets.load_encoder(w, m)


def test_stream_upserts_are_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, generation int").write.parquet(source)
    store = VersionedStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = spark.readStream.schema("k string, generation int").parquet(source)
        upsert_stream(stream, store, "t", "k", str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 2), ("b", 1)]


def test_dataset_files(spark, tmp_path):
    data = {"name": "n", "corpus": [{"id": "a", "title": "", "text": "t", "metadata": {"x": "y"}}], "queries": [{"id": "q", "text": "t", "limit": 3, "metadata_filters": [{"key": "x", "value": "y"}]}], "judgments": [{"query_id": "q", "item_id": "a", "relevance_grade": 2}],
            "embedding_model": {"model_id": "m", "dimension": 2}, "document_embeddings": [{"id": "a", "vector": [1, 0]}], "query_embeddings": []}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(data, indent=1))
    made = datasets.load_precomputed(spark, str(path))
    assert made["corpus"].first()["metadata"] == {"x": "y"} and made["queries"].first()["answer_mode"] == "JudgedRetrieval" and made["document_embeddings"].first()["embedding"] == [1.0, 0.0]
    assert len(datasets.file_digests(spark, str(path)).first()["sha256"]) == 64


def test_synthetic_inputs_are_deterministic(spark):
    a, b = (lexical_dataset(spark, 20, 16)["queries"].orderBy("query_id").collect() for _ in range(2))
    assert a == b and len(a) == 16
    by_class = {}
    for r in a:
        by_class.setdefault(r["query_type"], set()).add(len(r["text"].split()))
    assert {k: sorted(v) for k, v in by_class.items()} == {"exact": [7], "partial": [3], "graded": [2], "distractor_heavy": [4], "oov": [1], "no_answer": [1], "length_bias": [1], "repeated_term": [2]}
    assert clustered_vectors(spark, 10, 8).count() == 10
    vectors = random_vectors(spark, 40, 8)
    near = noisy_queries(vectors, 8, 10).join(vectors.withColumnRenamed("id", "target").withColumnRenamed("embedding", "v"), "target").collect()
    assert len(near) == 4 and all(sum(x * y for x, y in zip(r["embedding"], r["v"])) > 0.9 for r in near)
    stub = stub_dataset(spark)
    assert dataset_problems(stub["corpus"], stub["queries"], stub["qrels"]).count() == 0
    assert stub_run(spark.createDataFrame([("q",)], "query_id string"), lexical_dataset(spark, 20, 1)["corpus"], 5).count() == 5
