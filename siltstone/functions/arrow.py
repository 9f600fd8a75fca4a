"""Small vectorised helpers on Arrow tables, used inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer codes of a column, equal values having equal codes."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def starts(sorted_codes: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins."""
    if not len(sorted_codes):
        return np.empty(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(np.diff(sorted_codes)) + 1))


def rank_in_run(sorted_codes: np.ndarray) -> np.ndarray:
    """0-based place of each row in its run of equal codes."""
    first = starts(sorted_codes)
    sizes = np.diff(np.append(first, len(sorted_codes)))
    return np.arange(len(sorted_codes)) - np.repeat(first, sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of at least ``at_least`` rows that never cut a group, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        first = starts(codes(table[key]))
        if first[-1] == 0:
            continue
        yield table.slice(0, first[-1])
        rest = table.slice(first[-1]).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)
