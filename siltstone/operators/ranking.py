"""Ranked lists: fusion, decay, boolean and fuzzy matching, context budgets, chunk windows, bounded graph walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut, parallelism, stored


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, ... in the given order; each range counts its own rows, so no task gathers the table."""
    ranged = cut(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(name, local).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the same keys up to each row, without gathering a key in one task.

    The rows are range-partitioned by key and order; each range has its own sums, to which those of the ranges
    before it are added, one number per key and range.
    """
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order)
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_weight", weight))
    local = F.sum("_weight").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("_range", *keys).agg(F.sum("_weight").alias("_own"))
    before = sums.select("_range", *keys, (F.sum("_own").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_own")).alias("_before"))
    return ranged.withColumn(name, local).join(before, ["_range", *keys]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_weight", "_before")


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], constant: int = 60) -> DataFrame:
    """(query, item, score): sum of weight / (constant + rank) over ranked lists (query, item, rank)."""
    parts = [ranked.select("query", "item", (F.lit(weight) / (F.lit(float(constant)) + F.col("rank"))).alias("part")) for ranked, weight in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("query", "item").agg(F.sum("part").alias("score"))


def ranked_list(hits: DataFrame, query: str, item: str, score: str, k: int, higher: bool = True) -> DataFrame:
    """(query, item, rank) of the best k: one row per item with its best score, ties by item; nulls and NaN left out."""
    value = F.col(score).cast("double")
    clean = hits.select(F.col(query).alias("query"), F.col(item).alias("item"), (value if higher else -value).alias("v")).where("query is not null and item is not null and v is not null and not isnan(v)")
    best = clean.groupBy("query", "item").agg(F.max("v").alias("v"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("v"), "item")))
    return ranked.where(F.col("rank") <= k).select("query", "item", "rank")


def decayed(base: Column, age: Column, half_life: float, boost: float = 0.0, uses: Column | None = None, cooldown: float = 0.0, own: Column | None = None, echo: float = 0.3) -> Column:
    """base * exp(-age / half_life) + boost * ln(1 + uses).

    What is younger than ``cooldown`` counts nothing yet, and what is the asker's ``own`` only with ``echo``.
    """
    score = base * F.exp(-age / F.lit(float(half_life))) + (F.lit(boost) * F.log1p(uses) if uses is not None else F.lit(0.0))
    score = score if cooldown <= 0 else F.when(age < cooldown, F.lit(0.0)).otherwise(score)
    return score if own is None else score * F.when(own, F.lit(float(echo))).otherwise(F.lit(1.0))


def boolean_match(counts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query, doc): documents with all "must", at least one "should" where there are any, and no "must_not" terms.

    ``clauses`` is (query, term, occur). A query without must and should matches nothing.
    """
    distinct = clauses.distinct()
    sizes = distinct.groupBy("query").agg(F.sum((F.col("occur") == "must").cast("int")).alias("musts"), F.sum((F.col("occur") == "should").cast("int")).alias("shoulds"))
    hits = distinct.join(counts.select("doc", "term"), "term").groupBy("query", "doc").agg(*[F.sum((F.col("occur") == o).cast("int")).alias(o) for o in ("must", "should", "must_not")])
    return hits.join(sizes, "query").where("must = musts and must_not = 0 and (shoulds = 0 or should > 0) and must + should > 0").select("query", "doc")


def fuzzy_terms(vocabulary: DataFrame, terms: DataFrame, distance: int = 1) -> DataFrame:
    """(asked, term, distance): vocabulary terms within a Levenshtein distance of asked ones.

    An asked term is cut into distance + 1 pieces, of which a term within the distance has one unchanged, shifted by
    no more than the distance; only such pairs, of lengths that differ no more either, are compared. The pieces of a
    term are as many as the distance says, however long it is.
    """
    parts = F.sequence(F.lit(0), F.lit(distance))
    shifts = F.sequence(F.lit(-distance), F.lit(distance))
    start, end = F.floor(F.col("k") * F.col("n") / (distance + 1)).cast("int"), F.floor((F.col("k") + 1) * F.col("n") / (distance + 1)).cast("int")
    own = terms.select(F.col("term").alias("asked")).distinct().select("asked", F.length("asked").alias("n"), F.explode(parts).alias("k")).select("asked", "n", "k", F.substring(F.col("asked"), start + 1, end - start).alias("piece"))
    known = vocabulary.select("term").distinct().select("term", F.explode(F.transform(shifts, lambda d: F.length("term") + d)).alias("n")).where("n > 0").select("term", "n", F.explode(parts).alias("k"))
    known = known.select("term", "n", "k", F.explode(shifts).alias("s")).where((start + F.col("s") >= 0) & (end + F.col("s") <= F.length("term"))).select("term", "n", "k", F.substring(F.col("term"), start + F.col("s") + 1, end - start).alias("piece"))
    pairs = own.join(known, ["n", "k", "piece"]).select("asked", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("asked", "term")).where(F.col("distance") <= distance)


def within_budget(ranked: DataFrame, query: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """The leading rows of each query whose sizes together stay within a budget, with the running size."""
    running = F.sum(size).over(Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).where(F.col("used") <= budget)


def token_windows(docs: DataFrame, doc: str, tokens: Column, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(doc, window, start, tokens): windows of ``size`` tokens, each beginning ``overlap`` before the last one's end."""
    step = size - overlap
    spread = docs.select(F.col(doc).alias("doc"), tokens.alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - size) / step)).cast("int")
    return spread.select("doc", "t", F.explode(F.sequence(F.lit(0), last)).alias("window")).select("doc", "window", (F.col("window") * step).alias("start"), F.slice("t", F.col("window") * step + 1, size).alias("tokens"))


def heading_paths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section, level, heading, path, body): Markdown sections by heading line; section 0 is what comes before any.

    ``path`` has the headings that a section stands under, its own last: those before it of a lower level than all
    between. A # inside a fenced code block is no heading. An empty section 0 is left out; a null text gives no rows.
    """
    own = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "text")).where("doc is not null")
    lines = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)").cast("int")
    fenced = own.withColumn("fences", F.sum(fence).over(lines)).withColumn("inside", (F.col("fences") - fence) % 2 == 1)
    mark = F.regexp_extract("text", r"^(#{1,6})[ \t]+\S", 1)
    level = F.when(~F.col("inside"), F.length(mark)).otherwise(0)
    leveled = fenced.select("doc", "line", "text", level.alias("level")).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(lines))
    heads = leveled.where("level > 0").select("doc", "section", "level", F.trim(F.regexp_replace("text", r"^#{1,6}[ \t]+", "")).alias("heading"))
    bodies = leveled.where("level = 0").groupBy("doc", "section").agg(F.trim(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]))).alias("body"))
    # six columns hold the last heading of each level since one of a higher rank came
    above = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == k, F.struct("section", "heading"))).over(above) for k in range(1, 7)]
    placed = heads.select("doc", "section", "level", "heading", *[c.alias(f"_{k}") for k, c in enumerate(last, 1)])
    cut_ = [F.greatest(*[F.coalesce(F.col(f"_{j}.section"), F.lit(0)) for j in range(1, k)], F.lit(0), F.lit(0)) for k in range(1, 7)]
    path = F.array_compact(F.array(*[F.when((F.lit(k) <= F.col("level")) & (F.col(f"_{k}.section") > cut_[k - 1]), F.col(f"_{k}.heading")) for k in range(1, 7)]))
    sections = placed.select("doc", "section", "level", "heading", path.alias("path"))
    return sections.join(bodies, ["doc", "section"], "full").select("doc", "section", F.coalesce("level", F.lit(0)).alias("level"), "heading", F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("body", F.lit("")).alias("body")).where("section > 0 or body <> ''")


def walked_edges(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 64) -> DataFrame:
    """(seed, source, target, kind, weight, depth): the edges that a walk from each seed takes, ``most`` of them in all.

    Edges of a step are taken in the order of weight (highest first), kind, source and target, steps one after the
    other, until the walk has its number; a node is entered at its least depth only.
    """
    order = [F.desc("weight"), "kind", "source", "target"]
    # what one node gives a walk of that length at most; a walk never reads more of a node with very many edges
    best = edges.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "kind", "target"))).where(F.col("r") <= most).drop("r")
    seen = seeds.select("seed", F.col("seed").alias("node"))
    frontier, left, all_ = seen, seeds.select("seed", F.lit(most).alias("room")), None
    for d in range(1, depth + 1):
        step = frontier.join(best, F.col("node") == F.col("source")).drop("node")
        fresh = step.join(seen.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_anti")
        ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).join(left, "seed").where(F.col("r") <= F.col("room"))
        taken = stored(ranked.select("seed", "source", "target", "kind", "weight", F.lit(d).alias("depth")))
        all_ = taken if all_ is None else all_.unionByName(taken)
        frontier = taken.select("seed", F.col("target").alias("node")).distinct()
        seen = seen.unionByName(frontier)
        left = left.join(taken.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").select("seed", (F.col("room") - F.coalesce("n", F.lit(0))).alias("room"))
    return all_


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, fan_out: int = 64) -> DataFrame:
    """(seed, node, depth): nodes within ``depth`` steps, following each node's best ``fan_out`` edges by weight, kind, target.

    ``edges`` is (source, target, kind, weight), ``seeds`` (seed). A node has its least depth.
    """
    best = edges.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "kind", "target"))).where(F.col("r") <= fan_out).select("source", "target")
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = found
    for d in range(1, depth + 1):
        step = frontier.join(best, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        frontier = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(frontier)
    return found
