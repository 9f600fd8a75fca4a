"""Extension points: what analyzers, rerankers, embedders and encoders have to offer, defaults, a registry, an engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import bow_tokens
from siltstone.operators.index import LexicalIndex
from siltstone.operators.lexical import top_k
from siltstone.operators.signatures import LinearEncoder

# All of these take and give columns or DataFrames, so that an extension is part of the plan.


class Analyzer(Protocol):
    def __call__(self, text: Column) -> Column:
        """The terms of a text, as an array."""


class Embedder(Protocol):
    model_id: str
    dimension: int

    def embed(self, rows: DataFrame, item: str, text: str) -> DataFrame:
        """(item, embedding)."""


class Reranker(Protocol):
    def rerank(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """(query, doc, score) with other scores."""


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query, doc, score) for (query, text)."""


class Encoder(Protocol):
    name: str

    def encode(self, vectors: DataFrame, item: str, vector: str) -> DataFrame:
        """(id, words)."""


class Enricher(Protocol):
    def enrich(self, chunks: DataFrame) -> DataFrame:
        """The chunks with enriched_text and enrichment_level."""


class Chunker(Protocol):
    def chunk(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """(doc, chunk, text)."""


class Store(Protocol):
    def upsert(self, table: str, rows: DataFrame, key: str) -> int: ...

    def find(self, table: str, **equal) -> DataFrame: ...

    def erase(self, table: str, erased: DataFrame, owner: str) -> int: ...


class IdentityReranker:
    def rerank(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        return hits


@dataclass
class HashEmbedder:
    """Bags of words hashed to a fixed width: a term adds 1 to the component of its MD5, or subtracts it."""

    dimension: int = 64
    model_id: str = "hash"

    def embed(self, rows: DataFrame, item: str, text: str) -> DataFrame:
        terms = rows.select(F.col(item).alias("item"), F.explode(bow_tokens(F.col(text))).alias("term"))
        digest = F.md5("term")
        at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % self.dimension
        sign = 1 - 2 * (F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2)
        sums = terms.groupBy("item", at.alias("at")).agg(F.sum(sign).cast("float").alias("v"))
        parts = sums.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
        zero = F.lit(0.0).cast("float")
        whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.dimension - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), zero))
        return parts.select(F.col("item").alias(item), whole.alias("embedding"))


def vector_records(chunks: DataFrame, embedder: Embedder, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk, embedding, model_id) of the chunks that have a text; a repeated id counts once."""
    own = chunks.where(F.col(chunk).isNotNull() & (F.col(text) != "")).select(chunk, text).dropDuplicates([chunk])
    return embedder.embed(own, chunk, text).withColumn("model_id", F.lit(embedder.model_id))


@dataclass(frozen=True)
class SignatureInfo:
    """What makes signatures comparable: the same encoder with the same numbers over the same model."""

    encoder_id: str
    fingerprint: str
    dimension: int
    bits: int
    model_id: str

    def __post_init__(self):
        if not self.encoder_id or not self.model_id or self.dimension <= 0 or self.bits <= 0:
            raise ValueError("a signature's encoder and model need names and sizes")


#: The start and factor of the 64-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 14695981039346656037, 1099511628211


def fingerprint(encoder: LinearEncoder) -> str:
    """A hash of an encoder's name, rows and thresholds as 64-bit floats."""
    data = encoder.name.encode() + np.ascontiguousarray(encoder.rows, "<f8").tobytes() + np.ascontiguousarray(encoder.thresholds, "<f8").tobytes()
    h = FNV_START
    for byte in data:
        h = (h ^ byte) * FNV_FACTOR % (1 << 64)
    return f"{encoder.name}:{encoder.rows.shape[1]}:{encoder.rows.shape[0]}:{h:016x}"


def signature_info(encoder: LinearEncoder, model_id: str) -> SignatureInfo:
    return SignatureInfo(encoder.name, fingerprint(encoder), encoder.rows.shape[1], encoder.rows.shape[0], model_id)


def with_info(signatures: DataFrame, info: SignatureInfo) -> DataFrame:
    """Signatures that say in ``space`` what they may be compared with."""
    return signatures.withColumn("space", F.lit(f"{info.fingerprint}:{info.model_id}"))


def compatible(signatures: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, failing at run time where they have not one space together; nothing is read twice for it."""
    space = queries.select("space").distinct().groupBy().agg(F.collect_set("space").alias("spaces"))  # few
    ok = (F.size("spaces") == 1) & (F.col("space") == F.col("spaces")[0])
    checked = signatures.crossJoin(F.broadcast(space)).withColumn("space", F.when(ok, F.col("space")).otherwise(F.raise_error(F.lit("signatures of different encoders")))).where("space is not null").drop("spaces")
    return checked, queries


@dataclass
class EncoderRegistry:
    """Encoders by name; a name is given once."""

    known: dict[str, LinearEncoder] = field(default_factory=dict)

    def register(self, encoder: LinearEncoder) -> None:
        if not encoder.name:
            raise ValueError("an encoder needs a name")
        if encoder.name in self.known:
            raise ValueError(f"encoder {encoder.name} is registered already")
        self.known[encoder.name] = encoder

    def find(self, name: str) -> LinearEncoder | None:
        return self.known.get(name)

    def require(self, name: str) -> LinearEncoder:
        if name not in self.known:
            raise KeyError(f"no encoder {name}")
        return self.known[name]


@dataclass
class IndexRetriever:
    """BM25 over a stored index; queries beyond ``most`` hits are cut there."""

    index: LexicalIndex
    analyzer: Analyzer = bow_tokens
    most: int = 1024

    def retrieve(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query", F.explode(self.analyzer(F.col("text"))).alias("term"))
        hits = self.index.search(terms).withColumn("score", F.round("score", 6))
        return top_k(hits, "query", "doc", "score", self.most).drop("rank")


@dataclass
class RetrievalEngine:
    """A retriever, a reranker over its hits, and each query's own limit; extra filters go between the two."""

    retriever: Retriever
    reranker: Reranker = field(default_factory=IdentityReranker)
    allowed: Callable[[DataFrame], DataFrame] | None = None

    def search(self, queries: DataFrame, default_limit: int = 10) -> DataFrame:
        """(query, doc, score, rank) for (query, text) and, where there is one, hit_limit."""
        hits = self.retriever.retrieve(queries)
        hits = hits if self.allowed is None else self.allowed(hits)
        limit = F.coalesce("hit_limit", F.lit(default_limit)) if "hit_limit" in queries.columns else F.lit(default_limit)
        limits = queries.groupBy("query").agg(F.max(limit).alias("n"))
        ranked = self.reranker.rerank(hits, queries).join(limits, "query")
        return top_k(ranked, "query", "doc", "score", F.col("n")).drop("n")
