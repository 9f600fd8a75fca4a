"""Similar sets of terms by MinHash bands, checked exactly; term n-grams; BM25 over several fields."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.lexical import K1, B
from siltstone.session import stored

#: Bands and rows of the signatures, and the prime of the hash family, which leaves products within 64 bits.
BANDS, ROWS, PRIME = 32, 2, (1 << 31) - 1

#: How much a term in each field counts.
FIELD_WEIGHTS = {"title": 3.0, "heading": 2.5, "body": 1.0, "code": 1.5, "tag": 2.0, "symbol": 2.0, "meta": 0.5, "question": 4.0, "answer": 1.5, "summary": 1.5}


def ngrams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a column; a shorter text is one itself."""
    last = F.greatest(F.length(text) - n, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k + 1, F.lit(n))))


def ngram_similar(vocabulary: DataFrame, asked: DataFrame, n: int = 3, least: float = 0.5) -> DataFrame:
    """(asked, term, overlap): vocabulary terms by the Jaccard overlap of their n-grams, at least ``least``.

    Terms meet at shared n-grams only; the sizes travel with them, so nothing is looked up again.
    """
    side = lambda df, name: df.select(F.col("term").alias(name)).distinct().withColumn("g", ngrams(F.col(name), n)).select(name, F.size("g").alias(f"{name}_n"), F.explode("g").alias("g"))
    both = side(asked, "asked").join(side(vocabulary, "term"), "g").groupBy("asked", "term", "asked_n", "term_n").agg(F.count("*").alias("c"))
    return both.select("asked", "term", (F.col("c") / (F.col("asked_n") + F.col("term_n") - F.col("c"))).alias("overlap")).where(F.col("overlap") >= least)


def _family(count: int, seed: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in zip(rng.integers(1, PRIME, count), rng.integers(0, PRIME, count))]


def minhash_bands(items: DataFrame, item: str, terms: str, bands: int = BANDS, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """(item, band, key): for each band the least values of ``rows`` hash functions over the item's distinct terms."""
    base = F.pmod(F.xxhash64("term"), F.lit(PRIME))
    spread = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(terms)).alias("term")).where("term is not null").select("item", base.alias("h"))
    least = [F.min((F.col("h") * a + b) % PRIME).alias(f"m{k}") for k, (a, b) in enumerate(_family(bands * rows, seed))]
    signed = spread.groupBy("item").agg(*least)
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(*[f"m{k * rows + r}" for r in range(rows)]).alias("key")) for k in range(bands)])
    return signed.select("item", F.explode(keys).alias("k")).select("item", "k.band", "k.key")


def minhash_search(items: DataFrame, queries: DataFrame, item: str, terms: str, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(query, item, overlap): for a stated set of queries (ids of items), the other sets of terms whose Jaccard overlap
    with theirs is at least ``least``.

    Items with equal sets are one class, represented by its lowest id, so that a set that a third of all items have
    is one item here; both columns are representatives, and ``set_classes`` says who belongs to them. Candidates
    share a band (at 0.8, all but one in 10 ** 13 do); their overlap is exact.
    """
    members = stored(set_classes(items, item, terms))
    classes = members.where("item = representative").select("item", "terms")
    asked = members.join(queries.select(F.col(item).alias("item")), "item", "left_semi").select(F.col("representative").alias("item")).distinct()
    keys = stored(minhash_bands(classes, "item", "terms", bands, rows))
    own = keys.join(asked, "item", "left_semi").select(F.col("item").alias("query"), "band", "key")
    pairs = own.join(keys, ["band", "key"]).where("query <> item").select("query", "item").distinct()
    both = pairs.join(classes.select(F.col("item").alias("query"), F.col("terms").alias("ta")), "query").join(classes.select("item", F.col("terms").alias("tb")), "item")
    common = F.size(F.array_intersect("ta", "tb"))
    overlap = common / (F.size("ta") + F.size("tb") - common)
    return both.select("query", "item", overlap.alias("overlap")).where(F.col("overlap") >= least)


def shingles(tokens: Column, n: int = 5) -> Column:
    """The distinct runs of n tokens, joined by spaces; fewer tokens are one run, none give an empty array.

    ``tokens`` should be a plain column: it is read once for every run.
    """
    last = F.greatest(F.size(tokens) - n, F.lit(0))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda k: F.concat_ws(" ", F.slice(tokens, k + 1, n))))
    return F.when(F.size(tokens) > 0, runs).otherwise(F.array().cast("array<string>"))


def set_classes(items: DataFrame, item: str, terms: str) -> DataFrame:
    """(item, terms, representative): each item's distinct terms and the lowest item with the same ones."""
    own = items.select(F.col(item).alias("item"), F.sort_array(F.array_distinct(F.filter(terms, lambda t: t.isNotNull()))).alias("terms")).where("item is not null and size(terms) > 0")
    first = own.groupBy("terms").agg(F.min("item").alias("representative"))
    return own.join(first, "terms").select("item", "terms", "representative")


def bm25f(fields: DataFrame, query_terms: DataFrame, weights: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score): BM25 with a weight, a length and a mean length of its own for each field.

    ``fields`` is (doc, field, term, tf). A term's document frequency counts documents that have it in any field; the
    parts of all fields are added, each saturated and normalised by itself. A field without a weight counts 1.
    """
    w = F.coalesce(reduce(lambda c, kv: c.when(F.col("field") == kv[0], kv[1]), list((weights or FIELD_WEIGHTS).items()), F.when(F.lit(False), 0.0)), F.lit(1.0))
    asked = query_terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    lengths = fields.groupBy("doc", "field").agg(F.sum("tf").alias("length"))
    means = lengths.groupBy("field").agg(F.avg("length").alias("mean_length"))
    docs = fields.agg(F.countDistinct("doc").alias("docs"))
    used = fields.join(query_terms.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.countDistinct("doc").alias("df"))
    hits = asked.join(df, "term").join(used, "term").join(lengths, ["doc", "field"]).join(F.broadcast(means), "field").crossJoin(F.broadcast(docs))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * w * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("score"))
