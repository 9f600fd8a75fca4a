"""One ranking from several differently-scaled scores: outranking net flow on percentiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.arrow import codes, rank_in_run, starts, whole_groups
from siltstone.operators.ranking import running_sum
from siltstone.session import cut

#: Percentile differences up to INDIFFERENT don't count, from STRICT on they count in full, between them linearly.
INDIFFERENT, STRICT = 0.05, 0.5
#: Groups with more rows than this are ranked across tasks.
LARGE_GROUP = 1_000_000
#: Ranks to a block where a large group looks up shifted percentiles.
BLOCK = 32


def _flow_from_prefix(x: np.ndarray, n: np.ndarray, below: np.ndarray, sign: int) -> np.ndarray:
    """Sum over the group of max(0, sign * (x - percentile)), ``below`` being how many percentiles are under x.

    The percentiles of complete tie groups are mid-ranks, so the sum of the lowest c of n is c * c / (2 n).
    """
    low = below * below / (2 * n)
    return x * below - low if sign > 0 else n / 2 - low - x * (n - below)


def net_flow(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Net flow of each value within its group (rows sorted by group, then value), NaN for a NaN value.

    The mean over the other items of preference for minus preference against, from sorted prefix sums.
    """
    flow = np.full(len(value), np.nan)
    has = ~np.isnan(value)
    g, v = group[has], value[has]
    if not len(g):
        return flow
    first = starts(g)
    size = np.diff(np.append(first, len(g)))
    at = np.repeat(np.arange(len(first)), size)
    n, base = size[at].astype(float), first[at]
    new = np.concatenate(([True], (np.diff(v) != 0) | (np.diff(at) != 0)))
    tie = np.cumsum(new) - 1
    tie_first = np.flatnonzero(new)
    tie_end = np.append(tie_first[1:], len(v))
    x = ((tie_first[tie] - base) + (tie_end[tie] - base)) / (2 * n)
    key = 4.0 * at + x
    total = np.zeros(len(v))
    for shift, sign, part in ((-INDIFFERENT, 1, 1), (-STRICT, 1, -1), (INDIFFERENT, -1, -1), (STRICT, -1, 1)):
        t = x + shift
        below = np.clip(np.searchsorted(key, 4.0 * at + t, side="left") - base, 0, n)
        total += part * _flow_from_prefix(t, n, below, sign)
    flow[has] = total / ((STRICT - INDIFFERENT) * np.maximum(1, n - 1))
    return flow


def _task(weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g", 100_000):
            table = table.sort_by([("g", "ascending"), ("i", "ascending")])
            g = codes(table["g"])
            by_item = np.arange(len(g))
            total, places = np.zeros(len(g)), []
            for k, w in enumerate(weights):
                v = table[f"v{k}"].to_numpy(zero_copy_only=False).astype(float)
                order = np.lexsort((v, g))
                flow = np.empty(len(g))
                flow[order] = net_flow(g[order], v[order])
                total += w / sum(weights) * np.nan_to_num(flow)
                order = np.lexsort((by_item, np.nan_to_num(-v, nan=np.inf), np.isnan(v), g))
                place = np.empty(len(g), np.int64)
                place[order] = rank_in_run(g[order]) + 1
                places.append(pa.array(place, mask=np.isnan(v)))
            order = np.lexsort((by_item, -np.round(total, 9), g))
            place = np.empty(len(g), np.int64)
            place[order] = rank_in_run(g[order]) + 1
            yield from pa.table([table["g"], table["i"], pa.array(total), pa.array(place), *places], names=["g", "i", "flow", "place", *(f"p{k}" for k in range(len(weights)))]).to_batches()

    return run


def _large_groups(wide: DataFrame, weights: list[float]) -> DataFrame:
    """The same columns as _task gives, for groups of any size."""
    parts = []
    for k in range(len(weights)):
        own = wide.where(F.col(f"v{k}").isNotNull()).select("g", "i", F.col(f"v{k}").alias("v"))
        ties = own.groupBy("g", "v").agg(F.count("*").alias("c"))
        sizes = own.groupBy("g").agg(F.count("*").alias("n"))
        ties = running_sum(ties, ["g"], [F.col("v").asc()], F.col("c"), "e").join(sizes, "g").withColumn("s", F.col("e") - F.col("c"))
        ties = cut(ties.withColumn("x", (F.col("s") + F.col("e")) / (2 * F.col("n"))))
        shifts = F.array(*[F.struct(F.lit(a).alias("shift"), F.lit(b).alias("sign"), F.lit(c).alias("part")) for a, b, c in ((-INDIFFERENT, 1, 1), (-STRICT, 1, -1), (INDIFFERENT, -1, -1), (STRICT, -1, 1))])
        asked = ties.select("g", "v", "n", "x", F.explode(shifts).alias("q")).withColumn("t", F.col("x") + F.col("q.shift")).withColumn("at", F.least(F.greatest(F.floor(F.col("t") * F.col("n")), F.lit(0)), F.col("n") - 1))
        asked = asked.withColumn("block", F.floor(F.col("at") / BLOCK))
        blocks = ties.select("g", F.col("s").alias("bs"), F.col("e").alias("be"), F.col("x").alias("bx"), F.explode(F.sequence(F.floor(F.col("s") / BLOCK), F.floor((F.col("e") - 1) / BLOCK))).alias("block"))
        found = asked.join(blocks, ["g", "block"]).where("at >= bs and at < be")
        below = F.when(F.col("bx") < F.col("t"), F.col("be")).otherwise(F.col("bs"))
        low = below * below / (2 * F.col("n"))
        one = F.when(F.col("q.sign") > 0, F.col("t") * below - low).otherwise(F.col("n") / 2 - low - F.col("t") * (F.col("n") - below))
        flows = found.groupBy("g", "v", "n").agg((F.sum(F.col("q.part") * one)).alias("f"))
        flows = flows.select("g", "v", (F.lit(weights[k] / sum(weights)) * F.col("f") / ((STRICT - INDIFFERENT) * F.greatest(F.lit(1), F.col("n") - 1))).alias("f"))
        placed = running_sum(own, ["g"], [F.col("v").desc(), F.col("i").asc()], F.lit(1).cast("long"), "p")
        parts.append(placed.join(flows, ["g", "v"]).select("g", "i", "f", *[(F.col("p") if j == k else F.lit(None).cast("long")).alias(f"p{j}") for j in range(len(weights))]))
    flow = reduce(DataFrame.unionByName, parts).groupBy("g", "i").agg(F.sum("f").alias("flow"), *[F.max(f"p{j}").alias(f"p{j}") for j in range(len(weights))])
    placed = running_sum(flow, ["g"], [F.round(F.col("flow"), 9).desc(), F.col("i").asc()], F.lit(1).cast("long"), "place")
    return placed.select("g", "i", "flow", "place", *[f"p{j}" for j in range(len(weights))])


def fused_ranking(scores: list[tuple[DataFrame, str, bool]], group: str = "query_id", item: str = "chunk_id", weights: list[float] | None = None, large_group: int = LARGE_GROUP) -> DataFrame:
    """One ranking of every group's items from several tables of scores: (group, item, flow, place, place_0, ...).

    ``scores`` are (table, score column, higher is better). Within a table and group an item counts once, with its
    best score; rows with a null group, item or score or a NaN score don't count. A score becomes the percentile of
    its mid-rank in the table's group; an item's flow in a table is the mean over the others of preference for it
    minus preference for them, preference growing linearly from a difference of INDIFFERENT to one of STRICT. The
    weighted flows are added; a table without the item adds 0. ``place`` orders by flow to nine digits, then item. ``place_k``
    is the item's place in table k by score, then item; null where it isn't there. Equal scores have equal flow.
    Empty tables just add nothing.

    One shuffle of the merged tables and one by group. Groups beyond ``large_group`` rows are never gathered: ranks
    come from range partitions, and shifted percentiles are looked up by blocks of ranks.
    """
    weights = weights or [1.0] * len(scores)
    g, i = scores[0][0].schema[group].dataType, scores[0][0].schema[item].dataType
    best = []
    for k, (table, column, higher) in enumerate(scores):
        v = F.col(column).cast("double") + F.lit(0.0)
        own = table.select(F.col(group).alias("g"), F.col(item).alias("i"), (v if higher else -v).alias("v")).where("g is not null and i is not null and v is not null and not isnan(v)")
        best.append(own.select("g", "i", *[(F.col("v") if j == k else F.lit(None).cast("double")).alias(f"v{j}") for j in range(len(scores))]))
    wide = reduce(DataFrame.unionByName, best).groupBy("g", "i").agg(*[F.max(f"v{j}").alias(f"v{j}") for j in range(len(scores))])
    out = T.StructType([T.StructField("g", g), T.StructField("i", i), T.StructField("flow", T.DoubleType()), T.StructField("place", T.LongType()), *[T.StructField(f"p{k}", T.LongType()) for k in range(len(scores))]])
    rows = reduce(DataFrame.unionByName, [t.select(F.col(group).alias("g")) for t, _, _ in scores])
    large = rows.where("g is not null").groupBy("g").count().where(F.col("count") > large_group).select("g")
    some = bool(large.limit(1).count())
    small = wide.join(large, "g", "left_anti") if some else wide
    result = small.repartition("g").sortWithinPartitions("g").mapInArrow(_task(weights), out)
    if some:
        result = result.unionByName(_large_groups(cut(wide.join(large, "g", "left_semi")), weights))
    return _finish(result, group, item, len(scores))


def _finish(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    return df.select(F.col("g").alias(group), F.col("i").alias(item), "flow", "place", *[F.col(f"p{k}").alias(f"place_{k}") for k in range(n)])
