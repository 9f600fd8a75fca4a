"""Streams: records of rising generations into a versioned store, and windowed statistics with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.store import VersionedStore


def upsert_stream(stream: DataFrame, store: VersionedStore, table: str, key: str, checkpoint: str, generation: str = "generation", once: bool = True) -> StreamingQuery:
    """Each micro-batch replaces older generations; a batch that is delivered again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch, key, generation)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows by tumbling window and key; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("rows"))
