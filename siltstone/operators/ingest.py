"""Versioned resources: latest generations, idempotent replays, differences of record sets, ownership and reclaim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_generation(rows: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """The rows of each key's highest generation, without repeated ones; null keys are left out.

    A maximum per key, then a join with nothing after it, so that a key with many rows may be split.
    """
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(generation).alias("_top"))
    return rows.join(top, key).where(F.col(generation) == F.col("_top")).drop("_top")


def stale_rows(rows: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """(key, generation, rows): what a writer must refuse, being older than the key's highest generation."""
    top = rows.groupBy(key).agg(F.max(generation).alias("_top"))
    return rows.join(top, key).where(F.col(generation) < F.col("_top")).groupBy(key, generation).agg(F.count("*").alias("rows"))


def upsert(active: DataFrame, incoming: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Active rows with the keys of incoming ones of at least their generation replaced; stale incoming rows are refused."""
    seen = active.groupBy(key).agg(F.max(generation).alias("_top"))
    fresh = latest_generation(incoming, key, generation).join(seen, key, "left").where(F.col("_top").isNull() | (F.col(generation) >= F.col("_top"))).drop("_top")
    return active.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def replay_conflicts(active: DataFrame, incoming: DataFrame, key: str, content: list[str], generation: str = "generation") -> DataFrame:
    """(key, generation, conflict): incoming rows of a generation that is active; a conflict where the content differs."""
    a = active.select(key, generation, F.struct(*content).alias("_a"))
    b = incoming.select(key, generation, F.struct(*content).alias("_b"))
    return a.join(b, [key, generation]).groupBy(key, generation).agg(F.max((~F.col("_a").eqNullSafe(F.col("_b"))).cast("int")).alias("conflict"))


def manifest_diff(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """(identity, action): retain what both have, insert what only the new has, reclaim what only the old has."""
    a = old.select(*identity).distinct().withColumn("_old", F.lit(True))
    b = new.select(*identity).distinct().withColumn("_new", F.lit(True))
    action = F.when(F.col("_old") & F.col("_new"), "retain").when(F.col("_new"), "insert").otherwise("reclaim")
    return a.join(b, identity, "full").select(*identity, action.alias("action"))


def ownership_conflicts(rows: DataFrame, record: str, owner: str) -> DataFrame:
    """(record, owners): records that more than one resource claims; counted, never collected."""
    return rows.where(F.col(record).isNotNull() & F.col(owner).isNotNull()).groupBy(record).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def erase_resource(rows: DataFrame, erased: DataFrame, owner: str) -> DataFrame:
    """Rows without those of erased resources."""
    return rows.join(erased.select(owner).distinct(), owner, "left_anti")


def manifest_records(chunks: DataFrame) -> DataFrame:
    """(resource_id, chunk_id, ordinal, kind): the three derived records of each chunk, chunks in id order."""
    from pyspark.sql import Window

    distinct = chunks.select("resource_id", "doc_id", "chunk_id").where("chunk_id is not null").distinct()
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1
    kinds = F.array(*[F.lit(k) for k in ("chunk", "embedding", "vector_record")])
    return distinct.withColumn("ordinal", ordinal).select("resource_id", "chunk_id", "ordinal", F.explode(kinds).alias("kind"))


def snapshot_problems(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(problem, id): empty texts, chunks without document, ranges that are missing or don't fit their text."""
    empty = documents.where("text is null or text = ''").select(F.lit("document without text").alias("problem"), F.col("doc_id").cast("string").alias("id"))
    distinct = chunks.select("chunk_id", "doc_id", "source_range", "text").distinct()
    orphan = distinct.join(documents.select("doc_id"), "doc_id", "left_anti").select(F.lit("chunk without document"), "chunk_id")
    missing = distinct.where("source_range is null").select(F.lit("range missing"), "chunk_id")
    wrong = distinct.where("source_range.byte_length <> octet_length(text)").select(F.lit("range differs from text"), "chunk_id")
    return empty.union(orphan).union(missing).union(wrong)


def messages_to_threads(messages: DataFrame, thread: str, order: list[str], text: str) -> DataFrame:
    """(thread, messages, first, last): counts and ends of ordered messages, without gathering a thread in one row."""
    key = F.struct(*order, F.col(text).alias("text"))
    return messages.where(F.col(thread).isNotNull()).groupBy(thread).agg(F.count("*").alias("messages"), F.min(key)["text"].alias("first"), F.max(key)["text"].alias("last"))


def thread_messages(messages: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """Adds ``position``, from 1, to the messages of each thread in order; rows without a thread are left out.

    The numbers are running sums over ranges, so a thread that has a third of all messages is cut like any other.
    """
    from siltstone.operators.ranking import running_sum

    own = messages.where(F.col(thread).isNotNull())
    return running_sum(own, [thread], [F.col(c) for c in order], F.lit(1).cast("long"), "position")


def content_classes(units: DataFrame, unit: str, keys: list[str], text: str) -> DataFrame:
    """(unit, keys, digest, first, copies): units by their content key, which is some columns and the SHA-256 of the text.

    ``first`` is the lowest unit of the same key, ``copies`` how many have it; null texts and keys are values like
    others. Counts are added up before the shuffle, and the join has nothing after it.
    """
    keyed = units.select(F.col(unit).alias("unit"), *keys, F.sha2(F.col(text), 256).alias("digest"))
    names = [*keys, "digest"]
    classes = keyed.groupBy(*names).agg(F.min("unit").alias("first"), F.count("*").alias("copies"))
    a, b = keyed.alias("a"), classes.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    return a.join(b, reduce(lambda x, y: x & y, same)).select("a.unit", *[f"a.{c}" for c in names], "b.first", "b.copies")
