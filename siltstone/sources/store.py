"""A store of parquet tables in versions: writers add files and then a numbered pointer, readers follow the highest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ingest import erase_resource, latest_generation, upsert

#: Parts of a table by the hash of its key; an upsert writes those that it touches.
BUCKETS = 64


class VersionedStore:
    """Tables under a root folder, on any file system that Spark writes to; one writer at a time.

    A version is a list of files' folders, one for each bucket of keys. It is complete before its pointer is there,
    and pointers are only added, so a job that fails at any time leaves the last version in place and readers never
    see half of a write. A writer that finds its number taken fails. Old versions stay for readers that are at work
    and go with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _numbers(self, table: str) -> list[int]:
        folder = self._path(table)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removeprefix("_pointer-")) for n in names if n.startswith("_pointer-") and n.removeprefix("_pointer-").isdigit())

    def _pointer(self, table: str, number: int) -> dict:
        stream = self._fs.open(self._path(table, f"_pointer-{number:012d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def version(self, table: str) -> int | None:
        """The number of the current version."""
        numbers = self._numbers(table)
        return numbers[-1] if numbers else None

    def _current(self, table: str) -> dict:
        number = self.version(table)
        if number is None:
            raise FileNotFoundError(f"{self.root}/{table} has no version")
        return self._pointer(table, number)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of the current or of an earlier version."""
        pointer = self._current(table) if version is None else self._pointer(table, version)
        return self._files(table, pointer, [*pointer["parts"]])

    def _files(self, table: str, pointer: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/{table}/{pointer['parts'][b]}/_bucket={b}" for b in buckets]
        paths = [p for p in paths if self._fs.exists(self._path(p.removeprefix(self.root + "/")))]
        if not paths:
            from pyspark.sql import types as T

            return self.spark.createDataFrame([], T.StructType.fromJson(pointer["schema"]))
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def _bucket(self, key: str | None):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)) if key else F.pmod(F.spark_partition_id(), F.lit(self.buckets))

    def write(self, table: str, df: DataFrame, key: str | None = None) -> int:
        """A new version with these rows alone; with a key, later upserts write only the buckets they touch."""
        return self._add(table, df, key, {}, [str(b) for b in range(self.buckets)])

    def _add(self, table: str, df: DataFrame, key: str | None, kept: dict, buckets: list[str]) -> int:
        folder = f"v-{uuid.uuid4().hex}"
        marked = df.withColumn("_bucket", self._bucket(key).cast("int"))
        (marked.repartition("_bucket") if key else marked).write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{folder}")
        number = (self.version(table) or 0) + 1
        pointer = {"key": key, "buckets": self.buckets, "schema": df.schema.jsonValue(), "parts": kept | dict.fromkeys(buckets, folder)}
        temporary, final = self._path(table, f"_new-{folder}"), self._path(table, f"_pointer-{number:012d}")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(pointer).encode()))
        finally:
            stream.close()
        # renaming onto an existing name fails, so two writers can't both have a number
        if not self._fs.rename(temporary, final):
            raise OSError(f"version {number} of {table} is there already")
        return number

    def upsert(self, table: str, incoming: DataFrame, key: str, generation: str = "generation") -> int:
        """Replaces the keys of incoming rows, unless the stored generation is newer; other buckets stay as they are."""
        if self.version(table) is None:
            return self.write(table, latest_generation(incoming, key, generation), key)
        pointer = self._current(table)
        if pointer["key"] != key or pointer["buckets"] != self.buckets:
            return self.write(table, upsert(self.read(table), incoming, key, generation), key)
        touched = [str(r["b"]) for r in incoming.where(F.col(key).isNotNull()).select(self._bucket(key).alias("b")).distinct().collect()]  # at most BUCKETS
        if not touched:
            return self.version(table)
        merged = upsert(self._files(table, pointer, touched), incoming, key, generation)
        return self._add(table, merged, key, {b: p for b, p in pointer["parts"].items() if b not in touched}, touched)

    def erase(self, table: str, erased: DataFrame, owner: str) -> int:
        """A version without the rows of the erased owners."""
        return self.write(table, erase_resource(self.read(table), erased, owner), self._current(table)["key"])

    def find(self, table: str, **equal) -> DataFrame:
        """Rows whose columns have these values; the filter reaches the scan, and a key's value its bucket alone."""
        pointer = self._current(table)
        if pointer["key"] in equal:
            one = self.spark.createDataFrame([(equal[pointer["key"]],)], [pointer["key"]]).select(F.col(pointer["key"]).cast(dict(self.read(table).dtypes)[pointer["key"]])).select(F.pmod(F.xxhash64(pointer["key"]), F.lit(pointer["buckets"])).alias("b")).first()["b"]
            df = self._files(table, pointer, [str(one)])
        else:
            df = self.read(table)
        for column, value in equal.items():
            df = df.where(F.col(column) == F.lit(value))
        return df

    def vacuum(self, table: str) -> int:
        """Deletes the buckets that only older versions refer to, and their pointers; returns how many buckets."""
        numbers, gone = self._numbers(table), 0
        parts = self._pointer(table, numbers[-1])["parts"] if numbers else {}
        for status in self._fs.listStatus(self._path(table)):
            name = status.getPath().getName()
            if name.startswith("v-"):
                for own in self._fs.listStatus(status.getPath()):
                    bucket = own.getPath().getName()
                    if bucket.startswith("_bucket=") and parts.get(bucket.removeprefix("_bucket=")) != name:
                        self._fs.delete(own.getPath(), True)
                        gone += 1
            elif name.startswith("_new-") or (name.startswith("_pointer-") and int(name.removeprefix("_pointer-")) != numbers[-1]):
                self._fs.delete(status.getPath(), False)
        return gone


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def report_text(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, null fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
