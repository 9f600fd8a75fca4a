"""Splitting oversized texts: recursive bisection at the strongest boundary near the middle, then overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries by strength, strongest first; a cut comes after the match.
BOUNDARIES = (
    (5, regex.compile(r"\n[ \t]*\n\s*")),
    (4, regex.compile(r"\n[ \t]*")),
    (3, regex.compile(r"[.!?…।۔]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*")),
    (2, regex.compile(r"[,;:،؛]\s+|[，、；：]")),
    (1, regex.compile(r"\s+")),
)
#: Characters that end an unbroken run: white space and the three full stops of scripts without spaces.
BREAKS = regex.compile(r"[\s。！？]+")
#: The middle part of a segment in which the strongest boundary is taken before nearness to the middle.
MIDDLE = 0.25


def byte_offsets(text: str) -> np.ndarray:
    """The byte offset of each character and of the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where a text may be cut, ascending, and their strengths (the highest of each offset)."""
    at: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            at.setdefault(m.end(), strength)
    where = byte_offsets(text)[np.fromiter(at.keys(), np.int64, len(at))]
    order = np.argsort(where)
    return where[order], np.fromiter(at.values(), np.int64, len(at))[order]


def _whole(data: bytes, at: int) -> int:
    """The start of the character that has the byte at this offset."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of the pieces of a text in bytes, hard where the piece begins at no natural boundary."""
    data = text.encode()
    where, strength = boundaries(text)
    room = limit - overlap
    cores: list[tuple[int, int, bool]] = []
    stack = [(0, len(data), False)]
    while stack:
        a, b, hard = stack.pop()
        if b - a <= room or (not cores and a == 0 and b - a <= limit and b == len(data)):
            cores.append((a, b, hard))
            continue
        lo, hi = a + (b - a) * MIDDLE, b - (b - a) * MIDDLE
        i, j = np.searchsorted(where, [lo, hi])
        if i == j:
            i, j = np.searchsorted(where, a, side="right"), np.searchsorted(where, b)
            best = where[i:j]
            cut = int(best[np.abs(best - (a + b) / 2).argmin()]) if len(best) else None
        else:
            near, how = where[i:j], strength[i:j]
            near = near[how == how.max()]
            cut = int(near[np.abs(near - (a + b) / 2).argmin()])
        forced = cut is None
        if forced:
            cut = _whole(data, (a + b) // 2)
            if cut <= a:  # the middle is inside the first character
                cut = next((k for k in range(a + 1, b) if data[k] & 0xC0 != 0x80), b)
                if cut == b:
                    cores.append((a, b, hard))
                    continue
        stack += [(cut, b, forced), (a, cut, hard)]
    out = []
    for a, b, hard in cores:
        start = a
        if a:
            start = a - overlap
            while start < a and data[start] & 0xC0 == 0x80:
                start += 1
        out.append((max(0, start), b, hard))
    return out


def longest_run(text: str) -> int:
    """Bytes of the longest run without white space or an ideographic full stop, exclamation or question mark."""
    return max((len(x.encode()) for x in BREAKS.split(text)), default=0)


def split_oversized(items: DataFrame, item: str, text: str = "text", limit: int = 2400, overlap: int = 120, offset: str | None = None) -> DataFrame:
    """Pieces of at most ``limit`` bytes: (item, piece, piece_count, source_range, overlap,
    text, hard, unbroken).

    A text within the limit is one piece as it is. A larger one is cut in two at the strongest boundary (paragraph,
    line, sentence, clause, word) near its middle, and its halves again, until each is within the limit less the
    overlap; where there is no boundary it is cut between two characters, which marks the piece after it as
    ``hard``. Each piece but the first then begins ``overlap`` bytes earlier, less up to three bytes where that is
    inside a character; ``overlap`` is what it shares with the one before. ``source_range`` counts bytes from the start of the text, plus the column ``offset`` where
    one is named. ``unbroken`` says that the text has a run of more than ``limit`` bytes without any white space,
    `。`, `！` or `？`, so that no splitter of this limit can avoid a hard cut.

    A null text gives no rows, an empty one a single empty piece. Repeated rows give their pieces again. The limit
    must exceed the overlap by at least 4 bytes, the longest character.

    Each text is handled whole by one task; only those above the limit leave the JVM.
    """
    if limit - overlap < 4 or overlap < 0:
        raise ValueError("the limit must exceed the overlap by at least 4 bytes")
    kind = items.schema[item].dataType
    base = F.coalesce(F.col(offset).cast("long"), F.lit(0).cast("long")) if offset else F.lit(0).cast("long")
    narrow = items.select(F.col(item).alias("item"), F.col(text).alias("text"), base.alias("base")).where("text is not null")
    ranges = T.StructType([T.StructField("byte_offset", T.LongType()), T.StructField("byte_length", T.LongType())])
    out = T.StructType([T.StructField("item", kind), T.StructField("piece", T.LongType()), T.StructField("piece_count", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("byte_length", T.LongType()), T.StructField("overlap", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hard", T.BooleanType()), T.StructField("unbroken", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (whole, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column("base").to_pylist())):
                data, pieces, unbroken, end = whole.encode(), bisect_text(whole, limit, overlap), longest_run(whole) > limit, 0
                for n, (a, b, hard) in enumerate(pieces):
                    rows.append((k, n, len(pieces), at + a, b - a, max(0, end - a), data[a:b].decode(), hard, unbroken))
                    end = b
            if rows:
                index, *columns = zip(*rows)
                made = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string(), pa.bool_(), pa.bool_()])]
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(index)), *made], names=out.names)

    large = narrow.where(F.octet_length("text") > limit).mapInArrow(run, out)
    one = F.lit(1).cast("long")
    small = narrow.where(F.octet_length("text") <= limit).select("item", (one - 1).alias("piece"), one.alias("piece_count"), F.col("base").alias("byte_offset"), F.octet_length("text").cast("long").alias("byte_length"), (one - 1).alias("overlap"), "text", F.lit(False).alias("hard"), F.lit(False).alias("unbroken"))
    both = large.unionByName(small)
    return both.select(F.col("item").alias(item), "piece", "piece_count", F.struct("byte_offset", "byte_length").cast(ranges).alias("source_range"), "overlap", "text", "hard", "unbroken")
