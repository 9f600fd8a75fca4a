"""Mixing sources to target shares: raking to source, language and topic margins, then a calibrated sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import running_sum
from siltstone.session import stored

#: Rounds of raking at most, and the relative change at which it has converged.
ROUNDS, TOLERANCE = 200, 1e-9
#: Cells (source, language, topic) that the driver rakes at most; beyond, the same steps run as aggregates.
DRIVER_CELLS = 1_000_000
#: Share of the targets, among sources with tokens, that must be reached in full at the default size of the mix.
COVERED = 0.9
CELL = ["source", "language", "topic"]


def normal_source(column: Column) -> Column:
    """Lower case, without outer blanks, ``_`` written as ``-``."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), "_", "-")


def normal_language(column: Column) -> Column:
    """The primary subtag in lower case; und where there is none."""
    plain = F.regexp_extract(F.lower(F.trim(column)), "^[a-z]{2,3}", 0)
    return F.when(plain.isNull() | (plain == ""), "und").otherwise(plain)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.ones_like(b, dtype=float), where=b > 0)


def rake(cells: np.ndarray, tokens: np.ndarray, goal: np.ndarray, cap: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Copies of each cell by iterative proportional fitting, and the last relative change.

    ``cells`` has the codes of source, language and topic in three rows. Languages and topics keep the shares that
    the documents have; the last step of each round fits the sources to ``goal``. No cell exceeds its source's cap:
    what capped cells can't take goes to the source's others, in proportion.
    """
    source, *others = cells
    copies, change = np.where(tokens > 0, 1.0, 0.0), 0.0
    all_, want = tokens.sum(), goal.sum()
    own = [np.bincount(axis, tokens) for axis in others]
    limit = cap[source]
    for _ in range(rounds):
        before = copies
        for axis, margin in zip(others, own):
            now = np.bincount(axis, copies * tokens)
            copies = copies * _ratio(margin * (want / max(all_, 1)), now)[axis]
        copies = _fit_sources(source, tokens, copies, goal, limit)
        change = float(np.abs(copies - before).max(initial=0) / max(1.0, float(np.abs(copies).max(initial=0))))
        if change < TOLERANCE:
            break
    return copies, change


def _fit_sources(source: np.ndarray, tokens: np.ndarray, copies: np.ndarray, goal: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Copies times one factor per source, cut at the limit, so that each source has its goal."""
    order = np.lexsort((-copies, source))
    s, n, w = source[order], tokens[order], copies[order]
    first = np.concatenate(([True], np.diff(s) != 0)) if len(s) else np.empty(0, bool)
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    # what the cells before a row take when they are capped, and what the rest has
    capped = np.concatenate(([0.0], np.cumsum(n * limit[order])))
    weight = np.concatenate(([0.0], np.cumsum(n * w)))
    end = np.append(np.flatnonzero(first)[1:], len(s))[np.cumsum(first) - 1]
    at = np.arange(len(s))
    factor = np.maximum(0.0, _ratio(goal[s] - (capped[at] - capped[start]), weight[end] - weight[at]))
    fine = factor * w <= limit[order] * (1 + 1e-12)
    chosen = np.full(len(goal), np.inf)
    for k in np.flatnonzero(fine)[::-1]:  # the first row of each source from which on nothing is capped
        chosen[s[k]] = factor[k]
    made = np.where(np.isinf(chosen[source]), limit, np.minimum(limit, copies * np.where(np.isinf(chosen[source]), 0, chosen[source])))
    return np.where(tokens > 0, made, 0.0)


def rake_table(cells: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """The steps of ``rake`` over a table of cells (source, language, topic, n, goal, cap): (source, language, topic,
    copies) and the last change. For collections with more cells than the driver takes; each round is written."""
    c = cells.withColumn("copies", F.when(F.col("n") > 0, 1.0).otherwise(0.0))
    sums = cells.groupBy("source").agg(F.sum("n").alias("n"), F.max("goal").alias("goal")).agg(F.sum("n"), F.sum("goal")).first()
    scale, change = (sums[1] or 0.0) / max(sums[0] or 0, 1), 0.0
    for _ in range(rounds):
        step = c.withColumn("w", F.col("copies"))
        for axis in ("language", "topic"):
            margin = step.groupBy(axis).agg(F.sum("n").alias("own"), F.sum(F.col("w") * F.col("n")).alias("now"))
            step = step.join(margin, axis).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col("own") * scale / F.col("now")).otherwise(F.col("w"))).drop("own", "now")
        # cells are few against their documents, also those of one source
        down = Window.partitionBy("source").orderBy(F.desc("w"), "language", "topic").rowsBetween(Window.unboundedPreceding, -1)
        all_ = Window.partitionBy("source")
        zero = F.lit(0.0)
        rest = F.sum(F.col("n") * F.col("w")).over(all_) - F.coalesce(F.sum(F.col("n") * F.col("w")).over(down), zero)
        taken = F.coalesce(F.sum(F.col("n") * F.col("cap")).over(down), zero)
        step = step.withColumn("f", F.when(rest > 0, F.greatest(zero, (F.col("goal") - taken) / rest)).otherwise(1.0)).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("w"), "language", "topic")))
        chosen = F.min(F.when(F.col("f") * F.col("w") <= F.col("cap") * (1 + 1e-12), F.struct("place", "f"))).over(all_)["f"]
        step = step.withColumn("chosen", chosen)
        made = F.when(F.col("n") > 0, F.when(F.col("chosen").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("chosen")))).otherwise(0.0)
        step = stored(step.withColumn("new", made).select(*cells.columns, F.col("copies").alias("old"), F.col("new").alias("copies")))
        moved = step.agg(F.max(F.abs(F.col("copies") - F.col("old"))), F.max("copies")).first()
        c, change = step.drop("old"), (moved[0] or 0.0) / max(1.0, moved[1] or 0.0)
        if change < TOLERANCE:
            break
    return c.select("source", "language", "topic", "copies"), change


def default_total(share: np.ndarray, most: np.ndarray, covered: float = COVERED) -> float:
    """The largest total at which the sources that reach their share hold ``covered`` of the targets of all sources
    that have any tokens."""
    has = (share > 0) & (most > 0)
    if not has.any():
        return 0.0
    reach, own = most[has] / share[has], share[has]
    order = np.argsort(-reach)
    enough = np.flatnonzero(np.cumsum(own[order]) >= covered * own.sum() - 1e-12)
    return float(reach[order][enough[0]])


def mix(documents: DataFrame, targets: DataFrame, topics: DataFrame | None = None, doc: str = "doc_id", text: str = "text", seed: int = 42, total: float | None = None, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """A sample of the documents and its report.

    The sample: (doc, source, language, topic, tokens, copies), a row for each document of a listed source, copies
    possibly 0. The report, a row per source of ``targets``: (source, target_share, max_repeats, documents, tokens,
    target_tokens, most_tokens, reachable, goal_tokens, mixed_tokens, reached_share, on_goal, rake_change). Tokens
    are the bytes of the text, null having 0. ``target_tokens`` is the share of the tokens of all listed documents,
    ``most_tokens`` what the source has times max_repeats, ``reachable`` whether the latter suffices for the former.

    The mix has ``total`` tokens, by default those of ``default_total``: no size suits all sources, and a larger one
    lets those with few tokens fall short while all others overshoot their share of what comes out. ``goal_tokens``
    is the share of that total, or ``most_tokens`` where these are fewer. ``on_goal`` says that the mixed tokens are
    within the largest document of the source of it, ``rake_change`` how much the last round of
    raking still changed (below TOLERANCE it had converged).

    Every document row counts, also repeated ones and such without text; a source that isn't listed takes no part.
    ``topics`` has (doc, topic); the lowest topic of a document holds, a document without one is ``(none)``. Every
    language and topic is a margin of its own. Of repeated targets the largest holds; null shares count as 0, null
    repeats as 1. Copies are the whole part of the cell's weight; the rest of it goes to the documents that come
    first in the cell by a hash of id and seed, as far as their tokens reach: each has the same chance. A source is
    within about half a document of its goal, a cell within one or two.

    Texts are read once, to a narrow table. Running sums go by ranges of the hashed order, so a cell with a third of
    all rows is cut like any other.
    """
    wanted = targets.select(normal_source(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1).cast("long")), F.lit(0).cast("long")).alias("cap")).where("source is not null").groupBy("source").agg(F.max("share").alias("target_share"), F.max("cap").alias("max_repeats"))
    docs = documents.select(F.col(doc).alias("doc"), normal_source(F.col("source")).alias("source"), normal_language(F.col("lang")).alias("language"), F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("tokens"))
    docs = docs.join(wanted.select("source"), "source", "left_semi")
    if topics is not None:
        own = topics.select(F.col(doc).alias("doc"), "topic").where("doc is not null").groupBy("doc").agg(F.min("topic").alias("topic"))
        docs = docs.join(own, "doc", "left")
    else:
        docs = docs.withColumn("topic", F.lit(None).cast("string"))
    order = F.xxhash64("doc", F.lit(seed))
    docs = stored(docs.select("doc", "source", "language", F.coalesce("topic", F.lit("(none)")).alias("topic"), "tokens", order.alias("hash"), F.monotonically_increasing_id().alias("row")))
    cells = stored(docs.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("largest"), F.count("*").alias("documents")))
    sums = cells.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("n").alias("tokens"), F.max("largest").alias("slack"))
    # one row per source of the targets, whose table is as small as the list of sources
    sources = wanted.join(sums, "source", "left").orderBy("source").toPandas().fillna({"tokens": 0, "documents": 0, "slack": 0})
    share, cap = sources["target_share"].to_numpy(float), sources["max_repeats"].to_numpy(float)
    most = sources["tokens"].to_numpy(float) * cap
    size = default_total(share, most) if total is None else float(total)
    goal = np.minimum(share * size, most)
    spark = documents.sparkSession
    made = [(str(s), float(g), int(c)) for s, g, c in zip(sources["source"], goal, cap)]
    goals = spark.createDataFrame(made, "source string, goal double, cap long")
    weights, change = _weights(cells, goals, list(sources["source"]), goal, cap, driver_cells, rounds)
    weighted = docs.join(weights, ["source", "language", "topic"], "left").join(F.broadcast(goals.select("source", "cap")), "source")
    part = F.coalesce("copies", F.lit(0.0))
    whole = F.floor(part + 1e-9)
    weighted = weighted.select("doc", "source", "language", "topic", "tokens", "hash", "row", whole.cast("long").alias("whole"), F.greatest(part - whole, F.lit(0.0)).alias("rest"), "cap")
    summed = running_sum(weighted, CELL, [F.col("hash"), F.col("row")], F.col("tokens"), "upto")
    summed = stored(summed.join(cells.select(*CELL, (F.col("n")).alias("n")), CELL).select("doc", *CELL, "tokens", "whole", "cap", "upto", "rest", (F.col("rest") * F.col("n")).alias("wanted")))
    drawn = summed.join(_ends(summed), CELL, "left")
    taken = ((F.col("rest") > 0) & (F.col("upto") <= F.coalesce("end", F.lit(0).cast("long")))).cast("long")
    sample = stored(drawn.select("doc", *CELL, "tokens", F.least(F.col("whole") + taken, F.col("cap")).alias("copies")))
    mixed = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    return sample.withColumnRenamed("doc", doc), _report(sources, goal, mixed, change)


def _ends(summed: DataFrame) -> DataFrame:
    """(source, language, topic, end): the running sum up to which a cell's documents get one more copy.

    A cell's wanted tokens lie between two running sums. Of these the one is taken that keeps the sum over the cells
    of the source so far nearest to what they want, so that a source ends within half of a document of its goal. The
    cells of a source stream through one task in sorted order, however many there are.
    """
    ends = summed.where("rest > 0").groupBy(*CELL).agg(F.max("wanted").alias("wanted"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))), F.lit(0).cast("long")).alias("low"), F.max("upto").alias("most"), F.min(F.when(F.col("upto") > F.col("wanted"), F.col("upto"))).alias("high"))
    ends = ends.select(*CELL, "wanted", "low", F.coalesce("high", "most").alias("high"))
    own = ends.repartition("source").sortWithinPartitions("source", F.desc(F.col("high") - F.col("low")), "language", "topic")  # small steps last
    return own.mapInArrow(_settle, "source string, language string, topic string, end long")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of sorted cells; what a cell leaves open goes on to the next one of its source, also in later batches."""
    debt, last = 0.0, None
    for batch in batches:
        chosen = []
        for s, wanted, low, high in zip(*(batch.column(c).to_pylist() for c in ("source", "wanted", "low", "high"))):
            debt = wanted + (debt if s == last else 0.0)
            chosen.append(high if high - debt < debt - low else low)
            debt, last = debt - chosen[-1], s
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CELL), pa.array(chosen, pa.int64())], names=[*CELL, "end"])


def _weights(cells: DataFrame, goals: DataFrame, names: list[str], goal: np.ndarray, cap: np.ndarray, driver_cells: int, rounds: int) -> tuple[DataFrame, float]:
    """(source, language, topic, copies) of the cells that have tokens, and the last change of the raking."""
    full = cells.where("n > 0").join(F.broadcast(goals), "source").select("source", "language", "topic", "n", "goal", "cap")
    if full.count() > driver_cells:
        return rake_table(full, rounds)
    own = full.select("source", "language", "topic", "n").orderBy("source", "language", "topic").toArrow()
    at = {x: k for k, x in enumerate(names)}
    codes = [np.array([at[x] for x in own["source"].to_pylist()], np.int64), *(own[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("language", "topic"))]
    copies, change = rake(np.stack(codes), own["n"].to_numpy().astype(float), goal, cap, rounds) if own.num_rows else (np.empty(0), 0.0)
    table = own.drop_columns(["n"]).append_column("copies", pa.array(copies, pa.float64()))
    return cells.sparkSession.createDataFrame(table, "source string, language string, topic string, copies double"), change


def _report(sources, goal: np.ndarray, mixed: DataFrame, change: float) -> DataFrame:
    """The report's rows, one per source."""
    spark = mixed.sparkSession
    base = float(sources["tokens"].sum())
    rows = [(str(r.source), float(r.target_share), int(r.max_repeats), int(r.documents), int(r.tokens), float(r.target_share) * base, int(r.tokens) * int(r.max_repeats), float(g), int(r.slack)) for r, g in zip(sources.itertuples(), goal)]
    own = spark.createDataFrame(rows, "source string, target_share double, max_repeats long, documents long, tokens long, target_tokens double, most_tokens long, goal_tokens double, slack long")
    got = F.coalesce("mixed_tokens", F.lit(0).cast("long"))
    both = own.join(mixed, "source", "left").withColumn("mixed_tokens", got)
    all_ = both.agg(F.sum("mixed_tokens").alias("all_mixed"))
    return both.crossJoin(F.broadcast(all_)).select("source", "target_share", "max_repeats", "documents", "tokens", "target_tokens", "most_tokens", (F.col("most_tokens") >= F.col("target_tokens")).alias("reachable"), "goal_tokens", "mixed_tokens", F.when(F.col("all_mixed") > 0, F.col("mixed_tokens") / F.col("all_mixed")).alias("reached_share"), (F.abs(F.col("mixed_tokens") - F.col("goal_tokens")) <= F.col("slack")).alias("on_goal"), F.lit(change).alias("rake_change"))
