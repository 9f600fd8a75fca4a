"""A stored lexical index: postings by term, document lengths and document frequencies, kept up without rebuilding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.lexical import K1, B, bm25
from siltstone.session import parallelism, stored

TABLES = ("postings", "lengths", "terms")


@dataclass
class LexicalIndex:
    """Three tables that all lexical searches read instead of the texts.

    ``postings`` is (term, doc, tf) with positions where there are any, each file in the order of term and document, so
    that a scan for a few terms skips the rest of it by its statistics; ``lengths`` is (doc, token_count,
    unique_count, norm), ``terms`` (term, df, occurrences).
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    @staticmethod
    def build(rows: DataFrame) -> LexicalIndex:
        """The index of (doc, term, tf) rows, each pair once; further columns (positions) are kept.

        The texts are read once, for these rows. A term that a third of all documents have is cut by document.
        """
        ordered = rows.repartition(parallelism(rows.sparkSession), F.col("term"), F.pmod(F.xxhash64("doc"), F.lit(16))).sortWithinPartitions("term", "doc")
        postings = stored(ordered)
        return LexicalIndex(postings, stored(_lengths(postings)), stored(_terms(postings)))

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def open(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))

    def for_terms(self, wanted: DataFrame) -> DataFrame:
        """The postings of the terms that ``wanted`` has."""
        return self.postings.join(wanted.select("term").distinct(), "term", "left_semi")

    def updated(self, rows: DataFrame, erased: DataFrame | None = None) -> LexicalIndex:
        """The index with the documents of ``rows`` put in (replacing those of the same id) and those of ``erased`` (doc)
        taken out.

        Only the postings of replaced and erased documents are counted again, with a negative sign; frequencies of all
        other terms stay as they are, and a term without documents goes.
        """
        gone = rows.select("doc").distinct()
        gone = gone if erased is None else gone.unionByName(erased.select("doc")).distinct()
        old = self.postings.join(gone, "doc", "left_semi")
        signed = rows.select("term", F.lit(1).alias("n"), "tf").unionByName(old.select("term", F.lit(-1).alias("n"), (-F.col("tf")).alias("tf")))
        change = signed.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tf").alias("occurrences"))
        terms = self.terms.unionByName(change).groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where("df > 0")
        postings = self.postings.join(gone, "doc", "left_anti").unionByName(rows.select(*self.postings.columns))
        lengths = self.lengths.join(gone, "doc", "left_anti").unionByName(_lengths(rows))
        return LexicalIndex(postings, lengths, terms)

    def search(self, query_terms: DataFrame, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(query, doc, score) by BM25; see ``bm25``."""
        return bm25(self.postings, self.lengths, query_terms, allowed, self.terms, k1, b)


def _lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc").agg(F.sum("tf").alias("token_count"), F.count("*").alias("unique_count"), F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("norm"))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
