"""Top N items within every group, by bounded heaps that are built before the shuffle and merged after it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.arrow import codes, rank_in_run

BUFFER_ROWS = 200_000
#: Hash buckets of groups, each with the largest limit of its groups: what the tasks know of the limits before the
#: shuffle. This bounds what is collected and broadcast (2 MB), however many groups there are.
LIMIT_BUCKETS = 1 << 18


class BoundedHeaps:
    """One heap of the best distinct items for each group seen, pruned whenever the buffer has doubled.

    Items compare by score descending, then id ascending; an item counts once, with its highest score. Two
    heaps merge by pushing the rows of one into the other, so partial heaps may be built anywhere. ``n`` is one size
    for all groups, or an array of sizes by the bucket in the column b.
    """

    def __init__(self, n: int | np.ndarray):
        self.n, self.held, self.rows, self.room = n, [], 0, BUFFER_ROWS
        self.keys = ["g", "i"] if isinstance(n, int) else ["g", "i", "b"]

    def _sizes(self, rows: pa.Table) -> int | np.ndarray:
        return self.n if isinstance(self.n, int) else self.n[rows["b"].to_numpy()]

    def push(self, rows: pa.Table) -> None:
        if not isinstance(self.n, int):  # groups of which nothing is wanted
            rows = rows.filter(pa.array(self._sizes(rows) > 0))
        if rows.num_rows:
            self.held.append(rows)
            self.rows += rows.num_rows
            if self.rows >= self.room:
                kept = self.best().drop_columns(["place"])
                self.held, self.rows = [kept], kept.num_rows
                self.room = max(BUFFER_ROWS, 2 * self.rows)

    def best(self) -> pa.Table | None:
        """The rows kept so far, sorted within each group, with their 1-based place."""
        if not self.held:
            return None
        table = pa.concat_tables(self.held)
        table = table.group_by(self.keys).aggregate([("s", "max")]).rename_columns([*self.keys, "s"]).select(table.column_names)
        table = table.sort_by([("g", "ascending"), ("s", "descending"), ("i", "ascending")])
        place = rank_in_run(codes(table["g"]))
        return table.append_column("place", pa.array(place + 1, pa.int64())).filter(pa.array(place < self._sizes(table)))


def heap_task(n, with_place: bool):
    """For mapInArrow: rows (g, i, s) or (g, i, s, b) to those that the heaps keep; ``n`` may be a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = BoundedHeaps(n if isinstance(n, int) else n.value)
        for batch in batches:
            heaps.push(pa.Table.from_batches([batch]))
        best = heaps.best()
        if best is not None:
            yield from (best if with_place else best.drop_columns(["place"])).to_batches()

    return run


def bucket_limits(wanted: DataFrame) -> np.ndarray:
    """The largest limit n of the groups g in each bucket; an upper bound of each group's own."""
    found = wanted.groupBy(_bucket().alias("b")).agg(F.max("n").alias("n")).toArrow()
    sizes = np.zeros(LIMIT_BUCKETS, np.int64)
    sizes[found["b"].to_numpy()] = found["n"].to_numpy()
    return sizes


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("g"), F.lit(LIMIT_BUCKETS)).cast("int")


def top_n_per_group(hits: DataFrame, limits: DataFrame, group: str = "query_id", item: str = "chunk_id", score: str = "score", limit: str = "hit_limit", default_limit: int = 10) -> DataFrame:
    """The best items of every group of ``limits``, each group cut to its own limit: (group, item, score, place).

    A hit with a null group, item or score or a NaN score doesn't count; an item counts once per group with its
    highest score; the order is score descending, then item ascending (byte order for strings). A group whose limit
    is null keeps ``default_limit`` rows, one of limit 0 or less keeps none; of repeated limits the largest holds.
    Groups without hits, and hits of groups that aren't in ``limits``, give no rows. Empty tables give no rows;
    further columns are ignored.

    Only the heaps are shuffled, however large a group is: before the shuffle a heap has the limit of its group's
    hash bucket, which is the largest of the few groups that share it, and groups of buckets without a limit have
    none; the last join cuts each group to its own limit.
    """
    g, i, s = hits.schema[group].dataType, hits.schema[item].dataType, hits.schema[score].dataType
    wanted = limits.select(F.col(group).cast(g).alias("g"), F.coalesce(F.col(limit).cast("long"), F.lit(default_limit)).alias("n")).where("g is not null").groupBy("g").agg(F.max("n").alias("n")).where("n > 0")
    sizes = hits.sparkSession.sparkContext.broadcast(bucket_limits(wanted))
    number = F.col(score).cast("double") if not isinstance(s, (T.FloatType, T.DoubleType)) else F.col(score)
    narrow = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), (number + F.lit(0.0).cast(number_type(s))).alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)").withColumn("b", _bucket())
    plain = T.StructType([T.StructField("g", g), T.StructField("i", i), T.StructField("s", number_type(s)), T.StructField("b", T.IntegerType())])
    placed = T.StructType([*plain.fields, T.StructField("place", T.LongType())])
    built = narrow.mapInArrow(heap_task(sizes, False), plain)
    merged = built.repartition("g").mapInArrow(heap_task(sizes, True), placed)
    return merged.join(wanted, "g").where("place <= n").select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")


def number_type(s: T.DataType) -> T.DataType:
    """Float scores stay floats, all other numbers become doubles."""
    return s if isinstance(s, (T.FloatType, T.DoubleType)) else T.DoubleType()
