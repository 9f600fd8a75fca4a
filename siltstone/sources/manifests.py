"""Manifests of resources and owners of records, over the versioned store; older payloads are read with what they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.store import VersionedStore

RECORD = "array<struct<kind: string, chunk_id: string, ordinal: int>>"
#: The columns of a manifest, what a payload without one counts as, and the first payload version that has it.
COLUMNS = {
    "resource_id": ("string", None, 1),
    "generation": ("bigint", "0", 1),
    "records": (RECORD, "array()", 1),
    "pending_reclaim": (RECORD, "array()", 2),
    "body_digest": ("string", None, 3),
    "pipeline_hash": ("bigint", "0", 4),
    "schema_id": ("string", "''", 5),
    "schema_version": ("int", "0", 5),
}
CURRENT = 5
#: The order of a chunk's derived records.
KINDS = ("chunk", "embedding", "vector_record")


def current_payload(rows: DataFrame) -> DataFrame:
    """Manifests of any payload version (column payload_version, 1 where there is none) with the columns of the current
    one; a column that the row's version doesn't know counts as absent even where it is there."""
    version = F.coalesce("payload_version", F.lit(1)) if "payload_version" in rows.columns else F.lit(1)
    out = []
    for name, (kind, default, since) in COLUMNS.items():
        absent = F.expr(default).cast(kind) if default else F.lit(None).cast(kind)
        own = F.coalesce(F.col(name).cast(kind), absent) if name in rows.columns else absent
        out.append(F.when(version >= since, own).otherwise(absent).alias(name))
    return rows.select(*out, version.cast("int").alias("payload_version"))


def manifest_problems(manifests: DataFrame, schema_id: str) -> DataFrame:
    """(resource_id, problem): payloads to be migrated, foreign schemas, missing digests, and records out of order.

    The records of a chunk come together as chunk, embedding and vector_record of one ordinal, ordinals rising from 0
    (among those to be reclaimed, from any number); a document's own record may come first.
    """

    def ordered(column: str, dense: bool) -> F.Column:
        rest = F.when(F.try_element_at(column, F.lit(1))["kind"] == "document", F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))).otherwise(F.col(column))
        whole = F.size(rest) % 3 == 0
        kinds = F.forall(F.transform(rest, lambda r, i: r["kind"] == F.element_at(F.array(*map(F.lit, KINDS)), (i % 3 + 1).cast("int"))), lambda b: b)
        same = F.forall(F.transform(rest, lambda r, i: (r["ordinal"] == F.get(rest, (i - i % 3).cast("int"))["ordinal"]) & r["chunk_id"].eqNullSafe(F.get(rest, (i - i % 3).cast("int"))["chunk_id"])), lambda b: b)
        rising = F.forall(F.transform(rest, lambda r, i: F.when(i % 3 != 0, True).when(i == 0, (r["ordinal"] == 0) if dense else (r["ordinal"] >= 0)).otherwise(r["ordinal"] == F.get(rest, (i - 1).cast("int"))["ordinal"] + 1 if dense else r["ordinal"] > F.get(rest, (i - 1).cast("int"))["ordinal"])), lambda b: b)
        return F.coalesce(whole & kinds & same & rising, F.lit(False))

    rules = [
        (F.col("payload_version") != CURRENT, "payload to be migrated"),
        (F.col("schema_id") != schema_id, "foreign schema"),
        (~F.coalesce(F.col("body_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest missing"),
        (F.col("pipeline_hash") == 0, "pipeline hash missing"),
        (~ordered("records", True), "records out of order"),
        (~ordered("pending_reclaim", False), "records to reclaim out of order"),
    ]
    found = F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))
    return manifests.select("resource_id", F.explode(found).alias("problem"))


class ManifestStore:
    """One current manifest per resource."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = VersionedStore(spark, root)

    def upsert(self, rows: DataFrame) -> int:
        return self.store.upsert("manifests", current_payload(rows).withColumn("payload_version", F.lit(CURRENT)), "resource_id")

    def find(self, resource_id: str) -> DataFrame:
        return current_payload(self.store.find("manifests", resource_id=resource_id))

    def erase(self, resource_ids: DataFrame) -> int:
        return self.store.erase("manifests", resource_ids, "resource_id")

    def drain(self, deleted: DataFrame) -> int:
        """Takes the records (resource_id, chunk_id, kind) that have been deleted out of what is to be reclaimed.

        A step that is done again changes nothing, so a drain goes on where it was left.
        """
        gone = deleted.groupBy("resource_id").agg(F.collect_set(F.struct("chunk_id", "kind")).alias("gone"))
        rows = current_payload(self.store.read("manifests")).join(gone, "resource_id")
        left = F.filter("pending_reclaim", lambda r: ~F.array_contains("gone", F.struct(r["chunk_id"].alias("chunk_id"), r["kind"].alias("kind"))))
        return self.store.upsert("manifests", rows.withColumn("pending_reclaim", left).drop("gone"), "resource_id")


class OwnerStore:
    """Which resource a record belongs to: (record_key, kind, resource_id, generation)."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = VersionedStore(spark, root)

    def claim(self, rows: DataFrame) -> int:
        """Records that another resource owns are refused."""
        if self.store.version("owners") is not None:
            held = self.store.read("owners").select("record_key", F.col("resource_id").alias("_held"))
            rows = rows.join(held, "record_key", "left").where("_held is null or _held = resource_id").drop("_held")
        return self.store.upsert("owners", rows, "record_key")

    def owner(self, record_key: str) -> DataFrame:
        return self.store.find("owners", record_key=record_key)

    def release(self, resources: DataFrame) -> int:
        return self.store.erase("owners", resources, "resource_id")
