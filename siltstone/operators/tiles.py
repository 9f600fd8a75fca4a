"""Many queries against all documents without an index: documents as packed tiles that are scored for every distinct
bag of words, with no row per pair of query and document before the best are known."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.lexical import K1, B
from siltstone.session import stored

#: Documents of a tile; bags of words that go to the tasks at once (more are further passes over the tiles).
TILE_DOCS, SLICE = 4096, 10_000
MICRO = 1e6
#: Queries up to which a table of them goes to every task instead of being shuffled with what was found.
FEW = 500_000


def parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other has, and those of repeated keys, or None: only ids and repeated rows are shuffled."""
    again = rows.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    if again.isEmpty():
        return rows, None
    again = stored(again)
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def once(rows: DataFrame, key: str, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with those of a repeated key replaced by ``merged`` of them."""
    alone, again = parted(rows, key)
    return rows if again is None else alone.unionByName(merged(again))


def _spread(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For a column of arrays: the row of each value, and the values."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), column.flatten()


def _encode(fields: list[str], vocabulary: list[str], keep: list[str]):
    words = pa.array(vocabulary, pa.string())

    def tile(part: pa.RecordBatch) -> dict:
        ids = part.column("doc").to_pylist()
        D = len(ids)
        order = sorted(range(D), key=lambda i: ids[i] or "")
        place = np.empty(D, np.int64)
        place[order] = np.arange(D)
        out: dict = {"docs": [ids[i] for i in order]}
        lengths, sums, pairs = [], [], []
        norm = np.zeros(D)
        for n, name in enumerate(fields):
            rows, values = _spread(part.column(name))
            coded = values.dictionary_encode()
            codes, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
            known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)
            own, tf = np.unique(place[rows] * size + codes, return_counts=True)
            at, term = own // size, known[own % size] if len(known) else own
            length = np.bincount(at, tf, D)
            norm += np.bincount(at, tf.astype(float) ** 2, D)
            lengths.append(length)
            sums.append((int((length > 0).sum()), int(length.sum())))
            asked = term >= 0
            at, term, tf = at[asked], term[asked].astype(np.int64), tf[asked]
            pairs.append(term * D + at)
            by = np.argsort(term, kind="stable")
            out |= {f"at{n}": at[by].astype("<u2").tobytes(), f"term{n}": term[by].astype("<i4").tobytes(), f"tf{n}": tf[by].astype("<i4").tobytes(), f"len{n}": length.astype("<i4").tobytes()}
        terms, dfs = np.unique(pairs[0] // D, return_counts=True)
        filled = reduce(np.logical_or, [x > 0 for x in lengths])
        if len(fields) > 1:  # over fields distinct ids are counted, so not a missing one
            named = np.array([ids[i] is not None for i in order], bool)
            own = np.unique(np.concatenate(pairs))
            terms, dfs = np.unique(own[named[own % D]] // D, return_counts=True)
            filled = filled & named
        out |= {"norm": np.sqrt(norm).astype("<f8").tobytes(), "counted": int(filled.sum()), "texts": [a for a, _ in sums], "tokens": [b for _, b in sums], "terms": terms.tolist(), "dfs": dfs.tolist()}
        return out | {c: part.column(c).take(pa.array(order)) for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                made = tile(part := batch.slice(start, TILE_DOCS))
                kept = {c: made.pop(c) for c in keep}
                arrays = [pa.array([v], TYPES[k.rstrip("0123456789")]) for k, v in made.items()]
                arrays += [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), v) for v in kept.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*made, *kept])

    return run


TYPES = {"docs": pa.list_(pa.string()), "at": pa.binary(), "term": pa.binary(), "tf": pa.binary(), "len": pa.binary(), "norm": pa.binary(), "counted": pa.int64(), "texts": pa.list_(pa.int64()), "tokens": pa.list_(pa.int64()), "terms": pa.list_(pa.int32()), "dfs": pa.list_(pa.int64())}


@dataclass
class Tiles:
    """Documents in tiles, and what a score needs of the whole corpus: how many have tokens, and for each field how many
    and how many tokens; document frequencies by term of ``vocabulary``."""

    rows: DataFrame
    vocabulary: list[str]
    docs: int
    texts: list[int]
    tokens: list[int]
    df: np.ndarray

    @staticmethod
    def build(docs: DataFrame, vocabulary: list[str], fields: tuple[str, ...] = ("tokens",), keep: tuple[str, ...] = ()) -> Tiles:
        """Of rows (doc, an array of tokens for each field, columns to keep), each document once. Texts are read once;
        what is written holds the terms of ``vocabulary`` alone."""
        narrow = docs.select("doc", *fields, *keep).where(reduce(lambda a, b: a | b, [F.size(f) > 0 for f in fields]))
        names = ["docs", *[f"{x}{n}" for n in range(len(fields)) for x in ("at", "term", "tf", "len")], "norm", "counted", "texts", "tokens", "terms", "dfs"]
        kinds = {"docs": "array<string>", "counted": "bigint", "texts": "array<bigint>", "tokens": "array<bigint>", "terms": "array<int>", "dfs": "array<bigint>"}
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(kinds.get(n, "binary"))) for n in names] + [T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in keep])
        rows = stored(narrow.mapInArrow(_encode(list(fields), vocabulary, list(keep)), schema))
        sums = [F.sum("counted"), *[F.sum(F.col(c)[n]) for c in ("texts", "tokens") for n in range(len(fields))]]
        whole = [x or 0 for x in rows.agg(*sums).first()]
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in rows.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).collect():
            df[term] = n
        return Tiles(rows, vocabulary, whole[0], whole[1 : 1 + len(fields)], whole[1 + len(fields) :], df)


@dataclass
class Bag:
    """A distinct question: (term, times) pairs, how many documents it wants, and its own numbers and filters."""

    id: int
    terms: list[tuple[int, float]]
    k: int
    group: str = ""


@dataclass
class Bm25:
    """The part of a score that a term gives each document; over several fields with their weights."""

    tiles_docs: int
    mean: list[float]
    df: np.ndarray
    weights: list[float] = field(default_factory=lambda: [1.0])
    micro: float = MICRO

    def __call__(self, tile: dict, n: int, group: dict) -> np.ndarray:
        k1, b = group.get("k1") if group.get("k1") is not None else K1, group.get("b") if group.get("b") is not None else B
        term, at, tf = tile[f"term{n}"], tile[f"at{n}"], tile[f"tf{n}"]
        df = self.df[term]
        idf = np.log(1 + (self.tiles_docs - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * tile[f"len{n}"] / self.mean[n])
        return self.weights[n] * idf * tf * (k1 + 1) / (tf + norm[at])


def bm25_of(tiles: Tiles, weights: list[float] | None = None) -> Bm25:
    return Bm25(tiles.docs, [s / n if n else 1.0 for n, s in zip(tiles.texts, tiles.tokens)], tiles.df, weights or [1.0])


class Shared:
    micro = 1.0

    def __call__(self, tile: dict, n: int, group: dict) -> np.ndarray:
        return np.ones(len(tile[f"term{n}"]))


class Cosine:
    micro = MICRO

    def __call__(self, tile: dict, n: int, group: dict) -> np.ndarray:
        return tile[f"tf{n}"] / tile["norm"][tile[f"at{n}"]]


def _unpack(batch: pa.RecordBatch, row: int, fields: int, keep: list[str]) -> dict:
    tile: dict = {"docs": batch.column("docs")[row].as_py(), "norm": np.frombuffer(batch.column("norm")[row].as_py(), "<f8")}
    for n in range(fields):
        for name, kind in (("at", "<u2"), ("term", "<i4"), ("tf", "<i4"), ("len", "<i4")):
            tile[f"{name}{n}"] = np.frombuffer(batch.column(f"{name}{n}")[row].as_py(), kind)
    return tile | {c: batch.column(c)[row].as_py() for c in keep}


def _allowed(tile: dict, group: dict) -> np.ndarray | None:
    """Which documents have what a group asks for, ``equal`` of columns or one of its ``filters`` on metadata; None: all."""
    fits = None
    for column, value in group.get("equal", {}).items():
        own = np.array([x == value for x in tile[column]], bool)
        fits = own if fits is None else fits & own
    sets = group.get("filters")
    if sets and all(sets):
        memo = tile.setdefault("_pairs", {})

        def pair(key, value):
            # a filter without a value excludes nothing, one on a key that is missing asks for an empty text
            if (key, value) not in memo:
                memo[key, value] = np.array([value is None or (m.get(key) or "") == value for m in tile["_maps"]], bool)
            return memo[key, value]

        if "_maps" not in tile:
            tile["_maps"] = [dict(m) if m else {} for m in tile["metadata"]]
        own = reduce(np.logical_or, [reduce(np.logical_and, [pair(*f) for f in s]) for s in sets])
        fits = own if fits is None else fits & own
    return fits


def _best(bags: list[Bag], part: Callable, fields: int, keep: list[str]):
    groups: dict[str, list[Bag]] = {}
    for x in bags:
        groups.setdefault(x.group, []).append(x)
    packed = []
    for name, own in groups.items():
        sizes = np.array([len(x.terms) for x in own])
        packed.append((json.loads(name) if name else {}, own, np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array([t for x in own for t, _ in x.terms]), np.array([w for x in own for _, w in x.terms], float)))
    size = 1 + max((int(p[3].max()) for p in packed), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by group: what the last of a bag's best has, once it has as many as it wants, and its best (-score, doc)
        least = [np.full(len(p[1]), -np.inf) for p in packed]
        found: list[list[list]] = [[[] for _ in p[1]] for p in packed]
        for batch in batches:
            for row in range(batch.num_rows):
                tile = _unpack(batch, row, fields, keep)
                docs, D = tile["docs"], len(tile["docs"])
                present = np.unique(np.concatenate([tile[f"term{n}"] for n in range(fields)]))
                present = present[present < size]
                if not len(present):
                    continue
                local = np.full(size, len(present), np.int64)
                local[present] = np.arange(len(present))
                dense, numbers = None, None
                nameless = [i for i, d in enumerate(docs) if d is None]
                for g, (group, own, first, terms, weights) in enumerate(packed):
                    if dense is None or (group.get("k1"), group.get("b")) != numbers:
                        numbers, dense = (group.get("k1"), group.get("b")), np.zeros((len(present) + 1, D))
                        for n in range(fields):
                            ours = tile[f"term{n}"] < size
                            dense[local[tile[f"term{n}"][ours]], tile[f"at{n}"][ours]] += part(tile, n, group)[ours]
                        dense[:, nameless] = 0  # a document without an id counts for the corpus, but isn't found
                        most = dense.max(1)
                    x, where = dense, None
                    if (fits := _allowed(tile, group)) is not None:
                        where = np.flatnonzero(fits)
                        if not len(where):
                            continue
                    rows_ = local[terms]
                    ceiling = np.add.reduceat(weights * most[rows_], first)
                    open_ = np.flatnonzero((ceiling > 0) & (ceiling * (1 + 1e-9) >= least[g]))
                    if where is not None and len(open_):
                        # the rows of the open bags alone, over the documents that fit
                        wide = np.zeros(len(own), bool)
                        wide[open_] = True
                        used, rows_ = np.unique(np.where(np.repeat(wide, np.diff(np.append(first, len(terms)))), rows_, len(present)), return_inverse=True)
                        x = dense[np.ix_(used, where)]
                        ceiling = np.add.reduceat(weights * x.max(1)[rows_], first)
                        open_ = open_[(ceiling[open_] > 0) & (ceiling[open_] * (1 + 1e-9) >= least[g][open_])]
                    for q in open_:
                        bag, start = own[q], first[q]
                        end = start + len(bag.terms)
                        r = rows_[start:end]
                        score = weights[start] * x[r[0]]
                        for j in range(1, end - start):
                            score += weights[start + j] * x[r[j]]
                        hits = np.flatnonzero(score >= least[g][q]) if least[g][q] > 0 else np.flatnonzero(score > 0)
                        if not len(hits):
                            continue
                        value = np.floor(score[hits] * part.micro + 0.5)
                        best = np.argsort(-value, kind="stable")[: bag.k]
                        names = hits[best] if where is None else where[hits[best]]
                        mine = found[g][q] = sorted([*found[g][q], *zip((-value[best]).tolist(), [docs[i] for i in names])])[: bag.k]
                        if len(mine) == bag.k:
                            # what rounds to the last one's score may still come before it by its id
                            least[g][q] = max(1e-300, (-mine[-1][0] - 0.5) / part.micro * (1 - 1e-12) - 1e-12)
        for g, p in enumerate(packed):
            ids = [x.id for x, mine in zip(p[1], found[g]) for _ in mine]
            ks = [x.k for x, mine in zip(p[1], found[g]) for _ in mine]
            rows = [y for mine in found[g] for y in mine]
            for at in range(0, len(rows), 50_000):
                some = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 50_000], pa.int64()), pa.array([d for _, d in some], pa.string()), pa.array([-s / part.micro for s, _ in some], pa.float64()), pa.array(ks[at : at + 50_000], pa.int32())], names=["id", "doc", "score", "k"])

    return run


def best(tiles: Tiles, bags: list[Bag], part: Callable, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, doc, score, rank): the ``k`` best documents of each bag by rounded score, then by id, of those that share a
    term with it. ``bags`` are scored SLICE at a time, so what a task holds is bounded; each slice reads the tiles again.

    A tile is passed over for a bag where the sum of its terms' greatest parts can't reach what the bag has already.
    """
    fields = len(tiles.texts)
    columns = ["docs", "norm", *[f"{x}{n}" for n in range(fields) for x in ("at", "term", "tf", "len")], *keep]
    asked = sorted((x for x in bags if x.terms and x.k > 0), key=lambda x: x.group)
    parts = [tiles.rows.select(*columns).mapInArrow(_best(asked[at : at + SLICE], part, fields, list(keep)), "id bigint, doc string, score double, k int") for at in range(0, max(1, len(asked)), SLICE)]
    rows = stored(reduce(DataFrame.unionByName, parts))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("doc"))))
    return ranked.where("rank <= k").drop("k")


def numbered_keys(queries: DataFrame, *columns: str) -> tuple[list, DataFrame]:
    """The distinct values of ``columns`` as rows, and the queries' other columns with ``id``, a value's place there."""
    keyed = stored(queries.withColumn("_key", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    rows = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in columns]).orderBy("_key").collect()
    table = queries.sparkSession.createDataFrame([(n, r["_key"]) for n, r in enumerate(rows)], "id bigint, _key string")
    return rows, stored(keyed.join(table, "_key").drop("_key", *columns))


def for_queries(found: DataFrame, queries: DataFrame) -> DataFrame:
    """What was found by id for every query of that id; a moderate number of queries goes to where the rows are."""
    return found.join(F.broadcast(queries) if queries.count() <= FEW else queries, "id").drop("id")


def _boolean(units: list[tuple[int, list[int], list[int], list[int]]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tile = _unpack(batch, row, 1, [])
                docs, D = pa.array(tile["docs"], pa.string()), len(tile["docs"])
                present = np.unique(tile["term0"])
                local = np.full(size, len(present), np.int64)
                local[present] = np.arange(len(present))
                has = np.zeros((len(present) + 1, D), bool)
                has[local[tile["term0"]], tile["at0"]] = True
                ids, places, held = [], [], 0
                for unit, musts, nevers, others in units:
                    if (local[musts] == len(present)).any():
                        continue
                    hits = np.flatnonzero(has[local[musts]].all(0) & ~has[local[nevers]].any(0) & has[local[others]].any(0))
                    if len(hits):
                        ids.append(np.full(len(hits), unit))
                        places.append(hits)
                        held += len(hits)
                    if held > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), docs.take(pa.array(np.concatenate(places)))], names=["id", "doc"])
                        ids, places, held = [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), docs.take(pa.array(np.concatenate(places)))], names=["id", "doc"])

    return run


def boolean_rows(tiles: Tiles, units: list[tuple[int, list[int], list[int], list[int]]]) -> DataFrame:
    """(id, doc): documents with all of a unit's first terms, none of its second and one of its last."""
    parts = [tiles.rows.select("docs", "norm", "at0", "term0", "tf0", "len0").mapInArrow(_boolean(units[at : at + SLICE], len(tiles.vocabulary)), "id bigint, doc string") for at in range(0, max(1, len(units)), SLICE)]
    return reduce(DataFrame.unionByName, parts)


def _places(units: list[tuple[int, list[list[str]]]], slack: int):
    vocabulary = sorted({w for _, u in units for t in u for w in t})
    code = {w: n for n, w in enumerate(vocabulary)}
    words, V = pa.array(vocabulary, pa.string()), max(1, len(vocabulary))
    owners: dict[int, list[int]] = {}
    for unit, triples in units:
        for a, b, c in triples:
            owners.setdefault((code[a] * V + code[b]) * V + code[c], []).append(unit)
    triples = np.array(sorted(owners), np.int64)
    pairs = np.unique(triples // V)
    counts = np.array([len(owners[t]) for t in triples.tolist()], np.int64)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.empty(0, np.int64)
    owner = np.array([u for t in triples.tolist() for u in owners[t]], np.int64)
    heads = np.zeros(V + 1, bool)
    heads[pairs // V] = True
    # a unit of one triple that no other has needs no look at what else was found for it
    several = np.array(sorted(u for u, t in units if len(t) > 1), np.int64)

    def found(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, values)
        at[at == len(table)] = 0
        return table[at] == values, at

    def of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, values = _spread(part.column("tokens"))
        coded = values.dictionary_encode()
        if not len(coded.dictionary):
            return
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        c = known[coded.indices.to_numpy(zero_copy_only=False)]
        N = len(c)
        start = np.flatnonzero(heads[c] & (c >= 0))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, slack + 2):
            i = start[start + d < N]
            j = i + d
            ok = (rows[i] == rows[j]) & (c[j] >= 0)
            i, j = i[ok], j[ok]
            yes, _ = found(c[i] * V + c[j], pairs)
            i, j = i[yes], j[yes]
            for e in range(1, slack + 2):
                ok = j + e < N
                x, y, z = i[ok], j[ok], j[ok] + e
                ok = (rows[x] == rows[z]) & (c[z] >= 0)
                x, y, z = x[ok], y[ok], z[ok]
                yes, at = found((c[x] * V + c[y]) * V + c[z], triples)
                hits.append((at[yes], z[yes]))
        at, place = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        if slack:  # a place of the last term counts once, however it is reached
            both = np.unique(at * N + place)
            at, place = both // N, both % N
        D = part.num_rows
        pair, n = np.unique(at * D + rows[place], return_counts=True)
        at, doc = pair // D, pair % D
        if len(several):
            # places of units of several triples are told apart: for near ones, reached by two, they count once
            share = counts[at]
            unit = owner[np.repeat(begins[at], share) + _within(share)]
            doc, n = np.repeat(doc, share), np.repeat(n, share)
            alone = ~np.isin(unit, several)
            rest_u, rest_d, rest_n = _many(hits, unit_of=(begins, counts, owner), several=several, rows=rows, D=D, N=N, once=bool(slack))
            unit, doc, n = np.concatenate((unit[alone], rest_u)), np.concatenate((doc[alone], rest_d)), np.concatenate((n[alone], rest_n))
        else:
            share = counts[at]
            unit = owner[np.repeat(begins[at], share) + _within(share)]
            doc, n = np.repeat(doc, share), np.repeat(n, share)
        names = part.column("doc")
        for s in range(0, len(unit), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(unit[s : s + 200_000]), names.take(pa.array(doc[s : s + 200_000])), pa.array(n[s : s + 200_000].astype(np.int64))], names=["id", "doc", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(triples):
            return
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                yield from of(batch.slice(start, TILE_DOCS))

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of ``counts`` rows."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first, counts)


def _many(hits, unit_of, several, rows, D, N, once):
    begins, counts, owner = unit_of
    at, place = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    share = counts[at]
    unit, place = owner[np.repeat(begins[at], share) + _within(share)], np.repeat(place, share)
    mine = np.isin(unit, several)
    unit, place = unit[mine], place[mine]
    if once:
        both = np.unique(unit * N + place)
        unit, place = both // N, both % N
    pair, n = np.unique(unit * D + rows[place], return_counts=True)
    return pair // D, pair % D, n


def place_rows(docs: DataFrame, units: list[tuple[int, list[list[str]]]], slack: int = 0) -> DataFrame:
    """(id, doc, hits): how many places the runs of three terms of each unit have in a document, with up to ``slack``
    more terms between neighbours; with slack a place is one of the last term and counts once. Of (doc, tokens), each
    document once: texts are read by slices of SLICE units and nothing is shuffled."""
    parts = [docs.select("doc", "tokens").mapInArrow(_places(units[at : at + SLICE], slack), "id bigint, doc string, hits bigint") for at in range(0, max(1, len(units)), SLICE)]
    return reduce(DataFrame.unionByName, parts)
