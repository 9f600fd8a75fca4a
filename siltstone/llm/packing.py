"""Filling fixed-capacity containers: harmonic classes with a fixed item count per bin, planned on the sizes' counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ranking import numbered
from siltstone.session import stored

#: Distinct sizes that the plan tells apart; with larger capacities sizes count in whole steps, rounded up.
STEPS = 1 << 20


class Plan:
    """Which bins the items of each size go to, by their rank within the size.

    Class k has the sizes in (capacity / (k + 1), capacity / k] and k items to a bin. Bins are made from the largest
    class down, each with k items of its class, the largest that are left; the rest of the capacity is filled with
    smaller classes' items, the largest that fit first. A bin is repeated as often as the sizes it takes allow, so
    that each kind of bin uses up a size: there are no more kinds than distinct sizes, however many items there are.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        left = counts.astype(np.int64).copy()
        lower = np.arange(-1, len(left) - 1)  # for a size without items: a size below it that may have some

        def below(size: int) -> int:
            """The largest size from 1 to ``size`` that has items left; 0 where there is none."""
            found = size
            while found > 0 and left[found] == 0:
                found = int(lower[found])
            while size > found:
                lower[size], size = found, int(lower[size])
            return max(found, 0)

        given = np.zeros(len(left), np.int64)  # items of each size that have a bin
        segments: list[tuple[int, int, int, int]] = []  # size, first rank, first bin, items to a bin
        self.bins = 0
        largest = below(len(left) - 1)
        while largest:
            k = max(1, capacity // largest)
            bin_: dict[int, int] = {}
            space, wanted, size = capacity, k, largest
            while size and wanted and max(1, capacity // size) == k:
                n = min(wanted, int(left[size]))
                bin_[size] = n
                wanted, space = wanted - n, space - n * size
                size = below(size - 1)
            size = below(max(0, min(space, size)))
            while size:
                n = min(space // size, int(left[size]))
                bin_[size] = n
                space -= n * size
                size = below(min(space, size - 1))
            times = min(int(left[s]) // n for s, n in bin_.items())
            for s, n in bin_.items():
                segments.append((s, int(given[s]), self.bins, n))
                given[s] += n * times
                left[s] -= n * times
            self.bins += times
            largest = below(largest)
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))  # ranks go through all sizes, in order
        table = np.array(segments, np.int64).reshape(-1, 4)
        first = before[table[:, 0]] + table[:, 1]
        order = np.argsort(first)
        self.first, self.bin, self.items = first[order], table[order, 2], table[order, 3]
        self.empty = int(counts[0])

    def place(self, rank: np.ndarray) -> np.ndarray:
        """Bins of items by their rank in the order of sizes; items of size 0 come first and go to all bins in turn."""
        out = rank % max(1, self.bins)
        real = rank >= self.empty
        at = np.searchsorted(self.first, rank[real], side="right") - 1
        out[real] = self.bin[at] + (rank[real] - self.first[at]) // self.items[at]
        return out


def pack(items: DataFrame, item: str, size: str | None = None, text: str | None = None, capacity: int = 6144) -> DataFrame:
    """Containers of ``capacity``: (item, piece, piece_count, size_offset, size, container), one row per piece.

    The size is the column ``size``, or the bytes of ``text``; null counts as 0, as do sizes below it. Every row comes
    out, repeated ones as often as they stand; an item larger than the capacity becomes full pieces and one rest,
    no other is split. Items of size 0 go wherever there is a bin. A null item keeps its null. An empty table gives
    no rows. Containers are numbers from 0 without gaps, and the same however the rows lie in their files, but for
    rows that are equal in item and size.

    The driver gets one count per distinct size (at most ``capacity`` of them, and at most STEPS) and plans the bins;
    the narrow rows are range-partitioned by size and numbered, and each worker places its own by their numbers
    alone: all bins are full but for the last of the plan, however many workers there are.
    """
    kind = items.schema[item].dataType
    amount = F.octet_length(F.col(text)).cast("long") if text else F.col(size).cast("long")
    narrow = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(amount, F.lit(0).cast("long")), F.lit(0).cast("long")).alias("whole"))
    pieces = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1)).cast("long")
    cuts = narrow.withColumn("piece_count", pieces).select("item", "whole", "piece_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("piece_count") - 1)).alias("piece"))
    offset = F.col("piece") * capacity
    step = -(-capacity // STEPS)
    length = F.least(F.col("whole") - offset, F.lit(capacity).cast("long"))
    # the rows are numbered as they are written, so that equal ones can be told apart
    rows = stored(cuts.select("item", "piece", "piece_count", offset.alias("size_offset"), length.alias("size"), F.ceil(length / step).alias("steps"), F.monotonically_increasing_id().alias("row")))
    found = rows.groupBy("steps").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(capacity // step + 2, np.int64)
    counts[found["steps"].to_numpy()] = found["n"].to_numpy()
    plan = items.sparkSession.sparkContext.broadcast(Plan(counts, capacity // step))  # at most as many kinds of bins as sizes
    out = T.StructType([T.StructField("item", kind), *[T.StructField(c, T.LongType()) for c in ("piece", "piece_count", "size_offset", "size", "container")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = pa.array(plan.value.place(batch.column("rank").to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out.names[:-1]), placed], names=out.names)

    ranked = numbered(rows, ["steps", "item", "row"], "rank")
    return ranked.select(*out.names[:-1], "rank").mapInArrow(run, out).withColumnRenamed("item", item)
