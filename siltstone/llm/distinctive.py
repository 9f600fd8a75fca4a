"""How distinctive a term is per record: divergence of the smoothed record from the collection, term by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def current_records(records: DataFrame, value: str = "tokens") -> DataFrame:
    """One row per chunk, of its highest generation: (chunk_id, value). Of several such rows the largest value holds."""
    base = records.select("chunk_id", F.coalesce("generation", F.lit(-(2**63))).alias("generation"), F.col(value).alias("value")).where("chunk_id is not null")
    return base.groupBy("chunk_id").agg(F.max(F.struct("generation", "value")).alias("last")).select("chunk_id", F.col("last.value").alias(value))


def distinctive_terms(records: DataFrame, record: str = "chunk_id", tokens: str = "tokens", mu: float | None = None, min_records: int = 2) -> DataFrame:
    """Each record's terms with their part of the relative entropy between the record and the collection.

    Columns: (record, term, term_count, token_count, records, score). With p(t|d) = (tf + mu p(t)) / (|d| + mu) and
    p(t) the term's share of all tokens, score = p(t|d) ln(p(t|d) / p(t)); mu is the mean record length by default.
    Terms in fewer than ``min_records`` records have no row. Tokens are compared in lower case without outer blanks;
    null and blank tokens don't count, neither for the lengths. ``records`` has one row per record; a null record id
    or token list gives no rows, an empty table none. The length is counted, never taken from a column.

    The counts and lengths of a record need no shuffle where the input is partitioned by record. The term table is
    pre-aggregated and gives the collection's totals as well; the join on the term has nothing after it, so AQE may
    split a term that a third of all records have.
    """
    rows = records.select(F.col(record).alias("record"), F.explode(tokens).alias("token")).where("record is not null")
    kept = rows.select("record", F.lower(F.btrim("token", F.lit(BLANKS))).alias("term")).where("term <> ''")
    counts = kept.groupBy("record", "term").agg(F.count("*").alias("term_count"))
    own = Window.partitionBy("record")
    counts = counts.withColumn("token_count", F.sum("term_count").over(own))
    # each record is counted at its lowest term, so the totals follow from the table of terms
    first = (F.col("term") == F.min("term").over(own)).cast("long")
    terms = counts.withColumn("first", first).groupBy("term").agg(F.count("*").alias("records"), F.sum("term_count").alias("seen"), F.sum("first").alias("firsts"))
    whole = terms.agg(F.sum("firsts").alias("n"), F.sum("seen").alias("all_tokens"))
    terms = terms.where(F.col("records") >= min_records).crossJoin(F.broadcast(whole))
    prior = F.col("seen") / F.col("all_tokens")
    weight = F.lit(float(mu)) if mu is not None else F.col("all_tokens") / F.col("n")
    smoothed = (F.col("term_count") + weight * prior) / (F.col("token_count") + weight)
    return counts.join(terms, "term").select(F.col("record").alias(record), "term", "term_count", "token_count", "records", (smoothed * F.log(smoothed / prior)).alias("score"))
