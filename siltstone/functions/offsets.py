"""Tokens with byte ranges and positions, for callers that need to point into the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = re.compile(r"[A-Za-z0-9_./\\\-\u0080-\U0010FFFF][A-Za-z0-9_./\\:\-\u0080-\U0010FFFF]*")
SYMBOL = re.compile(r"[^\sA-Za-z0-9_./\\:\-\u0080-\U0010FFFF]|:")
NUMBER = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
TAIL = ".:,;!?"


def located(text: str, symbols: bool = False) -> list[tuple[str, int, int, str]]:
    """(token, first character, end, kind) in order; the trimmed ends of runs and lone signs count with ``symbols``."""
    out, at = [], 0
    while at < len(text):
        m = RUN.match(text, at)
        if not m:
            if symbols and SYMBOL.match(text, at):
                out.append((text[at], at, at + 1, "symbol"))
            at += 1
            continue
        raw, end = m[0], m.end()
        kind = "path" if "/" in raw or "\\" in raw else "number" if NUMBER.fullmatch(raw) else "identifier" if re.search(r"[_\-.:]|[a-z0-9][A-Z]|[A-Z]{2}[a-z]", raw) else "word"
        body = raw if kind == "number" else raw.rstrip(TAIL)
        if body:
            out.append((body.translate(LOWER), at, at + len(body), kind))
        if symbols:
            out += [(text[k], k, k + 1, "symbol") for k in range(at + len(body), end)]
        at = end
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def token_offsets(docs: DataFrame, doc: str, text: str, symbols: bool = False) -> DataFrame:
    """(doc, position, token, byte_offset, byte_length, kind): runs of the standard tokenizer, without identifier parts."""
    kind = docs.schema[doc].dataType
    names = ["doc", "position", "token", "byte_offset", "byte_length", "kind"]
    out = T.StructType([T.StructField("doc", kind), T.StructField("position", T.LongType()), T.StructField("token", T.StringType()), T.StructField("byte_offset", T.LongType()), T.StructField("byte_length", T.LongType()), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, whole in enumerate(batch.column("text").to_pylist()):
                found = located(whole, symbols)
                if not found:
                    continue
                points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
                byte = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
                first, end = byte[[f[1] for f in found]], byte[[f[2] for f in found]]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([k] * len(found))), pa.array(range(len(found)), pa.int64()), pa.array([f[0] for f in found]), pa.array(first), pa.array(end - first), pa.array([f[3] for f in found])], names=names)

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, out)
