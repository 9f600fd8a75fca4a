"""python tools/quality.py DATASET.json: quality of BM25 and bag-of-words cosine on an evaluation dataset, as JSON lines."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from siltstone.functions.text import bow_tokens  # noqa: E402
from siltstone.operators import lexical as L  # noqa: E402
from siltstone.operators import reports as P  # noqa: E402
from siltstone.operators.evaluation import dataset_problems  # noqa: E402
from siltstone.operators.index import LexicalIndex  # noqa: E402
from siltstone.session import get_session  # noqa: E402
from siltstone.sources.datasets import load_dataset  # noqa: E402


def main() -> None:
    spark = get_session("quality", "local[4]", spark__sql__shuffle__partitions="4")
    spark.sparkContext.setLogLevel("ERROR")
    data = load_dataset(spark, sys.argv[1])
    wrong = dataset_problems(data["corpus"], data["queries"], data["qrels"]).collect()
    if wrong:
        raise SystemExit(f"the dataset has problems: {wrong[:5]}")
    index = LexicalIndex.build(L.term_rows(data["corpus"].select(F.col("item_id").alias("doc"), "text"), "doc", bow_tokens(F.col("text"))))

    def terms(queries):
        return queries.select(F.col("query_id").alias("query"), F.explode(bow_tokens(F.col("text"))).alias("term"))

    def bm25(queries):
        return L.top_k(index.search(terms(queries)), "query", "doc", "score", 50)

    def bow(queries):
        counts = terms(queries).groupBy("query", "term").agg(F.count("*").alias("tf"))
        return L.top_k(L.bow_cosine(index.postings, counts, index.lengths, index.terms), "query", "doc", "score", 50)

    for name, retriever in (("bm25", bm25), ("bow", bow)):
        run = P.run_retriever(lambda q, r=retriever: r(q).select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), "rank"), data["queries"])
        row = P.evaluate(run, data["queries"], data["qrels"]).first().asDict()
        print(json.dumps({"retriever": name} | {k: round(v, 3) if isinstance(v, float) else v for k, v in row.items()}))


if __name__ == "__main__":
    main()
