"""Sources: evaluation datasets and precomputed embeddings in JSON, encoder weights, file digests."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.signatures import LinearEncoder, autoencoder

CORPUS = "array<struct<id: string, title: string, text: string, metadata: map<string, string>>>"
QUERIES = "array<struct<id: string, text: string, query_type: string, `limit`: bigint, metadata_filters: array<struct<key: string, value: string>>, answer_mode: string>>"
JUDGMENTS = "array<struct<query_id: string, item_id: string, relevance_grade: int>>"
VECTORS = "array<struct<id: string, vector: array<float>>>"
DATASET = f"name string, corpus {CORPUS}, queries {QUERIES}, judgments {JUDGMENTS}"
PRECOMPUTED = DATASET + f", schema_version int, embedding_model struct<model_id: string, dimension: int, similarity_metric: string, pooling_mode: string, normalized: boolean>, embedding_artifact map<string, string>, document_embeddings {VECTORS}, query_embeddings {VECTORS}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """corpus, queries and qrels of dataset files, one document a file; paths may be globs."""
    whole = _read(spark, path, DATASET)
    return _tables(whole)


def _tables(whole: DataFrame) -> dict[str, DataFrame]:
    corpus = whole.select("name", F.explode("corpus").alias("x")).select("name", F.col("x.id").alias("item_id"), "x.title", "x.text", "x.metadata")
    queries = whole.select("name", F.explode("queries").alias("x")).select("name", F.col("x.id").alias("query_id"), "x.text", "x.query_type", F.coalesce("x.limit", F.lit(10)).alias("hit_limit"), F.col("x.metadata_filters").alias("metadata_filters"), F.coalesce("x.answer_mode", F.lit("JudgedRetrieval")).alias("answer_mode"))
    qrels = whole.select("name", F.explode("judgments").alias("x")).select("name", "x.query_id", "x.item_id", F.col("x.relevance_grade").alias("grade"))
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


def load_precomputed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A dataset with its model, document and query embeddings; vectors of another width than the model's are an error."""
    whole = _read(spark, path, PRECOMPUTED)
    parts = _tables(whole)
    for name in ("document_embeddings", "query_embeddings"):
        rows = whole.select(F.col("embedding_model.dimension").alias("width"), F.explode(name).alias("x")).select(F.col("x.id").alias("id"), F.col("x.vector").alias("embedding"), "width")
        checked = F.when(F.size("embedding") == F.col("width"), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: width differs from the model's for "), F.col("id"))).cast("array<float>"))
        parts[name] = rows.select("id", checked.alias("embedding"))
    parts["model"] = whole.select("embedding_model.*")
    return parts


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def load_encoder(weights_path: str, manifest_path: str) -> LinearEncoder:
    """An affine encoder: little-endian float32 weights then biases, with bits, dimension and sha256 in a JSON manifest."""
    with open(manifest_path) as f:
        manifest = json.load(f)
    with open(weights_path, "rb") as f:
        raw = f.read()
    if manifest.get("sha256") and hashlib.sha256(raw).hexdigest() != manifest["sha256"]:
        raise ValueError("weights don't have the manifest's digest")
    bits, width = int(manifest["bits"]), int(manifest["dimension"])
    data = np.frombuffer(raw, "<f4")
    if len(data) != bits * width + bits:
        raise ValueError("weights don't have the manifest's size")
    return autoencoder(data[: bits * width].reshape(bits, width), data[bits * width :])


def save_encoder(encoder: LinearEncoder, weights_path: str, manifest_path: str) -> None:
    """What ``load_encoder`` reads."""
    raw = np.concatenate([encoder.rows.ravel(), -encoder.thresholds]).astype("<f4").tobytes()
    with open(weights_path, "wb") as f:
        f.write(raw)
    with open(manifest_path, "w") as f:
        json.dump({"bits": len(encoder.rows), "dimension": encoder.rows.shape[1], "sha256": hashlib.sha256(raw).hexdigest()}, f)


def load_matrix(spark: SparkSession, ids_path: str, matrix_path: str, width: int, sha256: str | None = None) -> DataFrame:
    """(id, embedding): a file of little-endian float32 rows with a file of their ids, one a line.

    The matrix is read in records of one row by the executors and numbered by its offset; a file whose size isn't a
    whole number of rows, whose digest isn't the given one, or that has another number of rows than ids is an error.
    """
    from pyspark.sql import types as T

    from siltstone.operators.ranking import numbered

    if sha256 and file_digests(spark, matrix_path).first()["sha256"] != sha256:
        raise ValueError("the matrix doesn't have the given digest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(matrix_path)
    size = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
    if size % (4 * width):
        raise ValueError("the matrix has no whole number of rows")
    records = spark.sparkContext.binaryRecords(matrix_path, 4 * width).zipWithIndex().map(lambda r: (r[1], r[0]))
    raw = spark.createDataFrame(records, T.StructType([T.StructField("no", T.LongType()), T.StructField("raw", T.BinaryType())]))

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            x = np.frombuffer(b"".join(b.column("raw").to_pylist()), "<f4")
            yield pa.RecordBatch.from_arrays([b.column("no"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(x))], names=["no", "embedding"])

    lines = spark.read.text(ids_path).select(F.col("value").alias("id"), F.monotonically_increasing_id().alias("at"))
    ids = numbered(lines, ["at"], "no").select("no", "id")
    if ids.count() != size // (4 * width):
        raise ValueError("there are not as many ids as rows")
    return raw.mapInArrow(rows, "no long, embedding array<float>").join(ids, "no").select("id", "embedding")


def load_materialized(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """documents and queries (id, embedding) and qrels (query_id, item_id, grade) of a folder with a manifest.json that
    names width and files; ids of the qrels that are in neither are an error."""
    with open(f"{root}/manifest.json") as f:
        manifest = json.load(f)
    parts = {name: load_matrix(spark, f"{root}/{manifest[name]['ids']}", f"{root}/{manifest[name]['matrix']}", manifest["dimension"], manifest[name].get("sha256")) for name in ("documents", "queries")}
    qrels = spark.read.schema("query_id string, item_id string, grade int").option("sep", "\t").csv(f"{root}/{manifest['qrels']}")
    strange = qrels.join(parts["queries"].select(F.col("id").alias("query_id")), "query_id", "left_anti").union(qrels.join(parts["documents"].select(F.col("id").alias("item_id")), "item_id", "left_anti").select("query_id", "item_id", "grade"))
    if strange.limit(1).count():
        raise ValueError("qrels name ids that aren't there")
    return parts | {"qrels": qrels}
