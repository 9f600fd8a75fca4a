"""Names of the data model's kinds, and small predicates and defaults on records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ascii_lower

# The names that records may have; the last of each is what an unknown name counts as.
NAMES = {
    "source_kind": "text markdown chat code structured event custom unknown",
    "token_kind": "word identifier number path symbol custom",
    "author_role": "user assistant system tool other",
    "embedding_purpose": "query document symmetric classification custom",
    "similarity_metric": "cosine dot_product euclidean",
    "pooling_mode": "model_default mean cls last_token custom",
    "object_type": "document section episode memory_card chunk",
}


def parsed_name(kind: str, column: Column) -> Column:
    """The name that a text in any letter case stands for; null where it is none of the kind's."""
    plain = ascii_lower(column)
    return F.when(plain.isin(*NAMES[kind].split()), plain)


def name_or_default(kind: str, column: Column) -> Column:
    """As ``parsed_name``, with the kind's last name for everything else."""
    return F.coalesce(parsed_name(kind, column), F.lit(NAMES[kind].split()[-1]))


def has_content(text: Column) -> Column:
    """Whether there is any text; false for null."""
    return F.coalesce(text != "", F.lit(False))


def has_embedding(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def passthrough_enrichment(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds enriched_text, the text as it is, and enrichment_level 0."""
    return chunks.withColumn("enriched_text", F.col(text)).withColumn("enrichment_level", F.lit(0))
