"""Frequency of every distinct term: a global dictionary, count arrays by block, sums by identifier range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ranking import numbered
from siltstone.session import parallelism, stored

#: Identifiers to a range: one array of this length per range and task.
RANGE = 1 << 16


class BlockCounts:
    """Occurrences and record presence of a task's own rows: blocks are encoded with a growing dictionary and added up."""

    def __init__(self):
        self.terms: pa.Array | None = None
        self.seen: np.ndarray = np.zeros(0, np.int64)
        self.records: np.ndarray = np.zeros(0, np.int64)
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, terms: pa.Array, seen: np.ndarray) -> None:
        block = terms.dictionary_encode()
        code = block.indices.to_numpy(zero_copy_only=False)
        n = len(block.dictionary)
        self.held.append((block.dictionary, _sums(code, seen, n), np.bincount(code, minlength=n).astype(np.int64)))
        self.rows += n
        if self.rows > 2 * max(100_000, len(self.seen)):
            self.merge()

    def merge(self) -> None:
        parts = self.held if self.terms is None else [(self.terms, self.seen, self.records), *self.held]
        if parts:
            whole = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            code, n = whole.indices.to_numpy(zero_copy_only=False), len(whole.dictionary)
            self.seen = _sums(code, np.concatenate([p[1] for p in parts]), n)
            self.records = _sums(code, np.concatenate([p[2] for p in parts]), n)
            self.terms, self.held, self.rows = whole.dictionary, [], 0


def _sums(code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Integer sums by code, exact beyond 2**53."""
    out = np.zeros(n, np.int64)
    np.add.at(out, code, weight)
    return out


def _block_task(term: pa.DataType, record: pa.DataType):
    """Rows (term, record, n) to one row per distinct term of the task, and one with the record alone per distinct record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, records, held = BlockCounts(), [], 0
        names = ["term", "seen", "records", "record"]

        def present() -> Iterator[pa.RecordBatch]:
            own = pc.unique(pa.concat_arrays(records))
            for at in range(0, len(own), 50_000):
                part = own.slice(at, 50_000)
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), term), none, none, part], names=names)

        for b in batches:
            if b.num_rows:
                counts.add(b.column("term"), b.column("n").to_numpy())
                records.append(pc.unique(b.column("record")))
                held += len(records[-1])
                if held > 500_000:
                    yield from present()
                    records, held = [], 0
        if records:
            yield from present()
        counts.merge()
        if counts.terms is not None:
            table = pa.table([counts.terms, pa.array(counts.seen), pa.array(counts.records), pa.nulls(len(counts.terms), record)], names=names)
            yield from table.to_batches(max_chunksize=50_000)

    return run


def _range_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of identifier ranges: (term, code, seen, records) to one row per identifier."""
    ranges: dict[int, tuple] = {}
    for b in batches:
        if not b.num_rows:
            continue
        code, seen, records = (b.column(c).to_numpy() for c in ("code", "seen", "records"))
        for r in np.unique(code // RANGE):
            if r not in ranges:
                ranges[r] = (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64), [], [])
            s, n, terms, own = ranges[r]
            here = np.flatnonzero(code // RANGE == r)
            at = code[here] % RANGE
            new, first = np.unique(at, return_index=True)
            fresh = n[new] == 0
            terms.append(b.column("term").take(pa.array(here[first[fresh]])))
            own.append(new[fresh])
            np.add.at(s, at, seen[here])
            np.add.at(n, at, records[here])
    for r, (s, n, terms, own) in ranges.items():
        at = np.concatenate(own)
        table = pa.table([pa.chunked_array(terms), pa.array(at + r * RANGE), pa.array(s[at]), pa.array(n[at])], names=["term", "code", "seen", "records"])
        yield from table.to_batches(max_chunksize=50_000)


def term_frequencies(occurrences: DataFrame, term: str, record: str, count: str, min_records: int = 3, max_share: float = 0.25, unique: bool = False) -> DataFrame:
    """Occurrences and records of every distinct term: (term, term_code, occurrences, records, all_records, mark).

    ``occurrences`` has one row per term and record with its count; repeated rows count once, with the largest
    count. Rows with a null term, record or count, or a count below 1, don't count. ``mark`` is rare for a term in
    fewer than ``min_records`` records, else common for one in more than ``max_share`` of all records that have a
    row, else null. ``unique`` says that no term and record are repeated, which saves a shuffle. ``term_code`` numbers
    the terms 0, 1, ... in their order. An empty table gives no rows.

    The rows are read once: each task reduces its own to one count per term (so that a term in a third of all rows is
    a row per task) and one row per record. From the terms of these blocks the dictionary is built, range-partitioned
    and numbered; the blocks are encoded by it and summed up in arrays by ranges of identifiers.
    """
    kind, owner = occurrences.schema[term].dataType, occurrences.schema[record].dataType
    rows = occurrences.select(F.col(term).alias("term"), F.col(record).alias("record"), F.col(count).cast("long").alias("n")).where("term is not null and record is not null and n >= 1")
    if not unique:
        rows = rows.groupBy("record", "term").agg(F.max("n").alias("n"))
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [T.StructField("term", kind), T.StructField("seen", T.LongType()), T.StructField("records", T.LongType())]
    blocks = stored(rows.mapInArrow(_block_task(to_arrow_type(kind), to_arrow_type(owner)), T.StructType([*fields, T.StructField("record", owner)])))
    counts = blocks.where("term is not null").select("term", "seen", "records")
    dictionary = numbered(counts.select("term").distinct(), ["term"], "code")
    encoded = counts.join(dictionary, "term").select("term", F.col("code").cast("long").alias("code"), "seen", "records")
    parts = encoded.repartition(parallelism(occurrences.sparkSession), F.floor(F.col("code") / RANGE))
    sums = parts.mapInArrow(_range_task, T.StructType([fields[0], T.StructField("code", T.LongType()), *fields[1:]]))
    total = blocks.where("record is not null").select("record").distinct().agg(F.count("*").alias("all_records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.col("all_records") * F.lit(max_share), "common")
    return sums.crossJoin(F.broadcast(total)).select("term", F.col("code").alias("term_code"), F.col("seen").alias("occurrences"), "records", "all_records", mark.alias("mark"))


def current_postings(postings: DataFrame) -> DataFrame:
    """Postings of the highest generation that is found for their chunk: (token_id, chunk_id, term_frequency).

    Rows with a null chunk_id don't count; a null generation is lower than any. A chunk's generation counts all its
    rows, also those without a token. Rows are brought to one per chunk and token first, which spreads a large
    chunk over all tasks; the join with the generations has no grouping after it, so that a skewed one is split.
    """
    base = postings.select("token_id", "chunk_id", F.coalesce("generation", F.lit(-(2**63))).alias("generation"), "term_frequency").where("chunk_id is not null")
    latest = base.groupBy("chunk_id", "token_id").agg(F.max(F.struct("generation", "term_frequency")).alias("last"))
    top = base.groupBy("chunk_id").agg(F.max("generation").alias("top"))
    return latest.join(top, "chunk_id").where("last.generation = top").select("token_id", "chunk_id", F.col("last.term_frequency").alias("term_frequency"))
