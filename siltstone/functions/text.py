"""Tokenizers as column expressions: everything here stays in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that only space a query.
SPACE = r"[ \t\n\x0B\f\r]+"
# Runs start with a letter, digit, non-ASCII character or one of _ - . / \ ; a colon may follow.
RUN = r"[A-Za-z0-9_./\\\-\x{80}-\x{10FFFF}][A-Za-z0-9_./\\:\-\x{80}-\x{10FFFF}]*"
TRAILING = r"[.:,;!?]+$"
PARTS = r"[_\-.:]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only; É stays É."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bow_tokens(text: Column) -> Column:
    """Runs of two or more of a-z and 0-9 in the lowered text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]{2,}"), 0), F.array().cast("array<string>"))


def space_terms(text: Column) -> Column:
    """Terms between white space, as they are; a text of white space only is itself one term."""
    terms = F.filter(F.split(text, SPACE), lambda t: t != "")
    return F.when(F.size(terms) > 0, terms).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def token_kind(token: Column) -> Column:
    """path, number, identifier or word, decided on the token as it stands in the text."""
    return (
        F.when(token.contains("/") | token.contains("\\"), "path")
        .when(token.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), "number")
        .when(token.rlike(r"[_\-.:]|[a-z0-9][A-Z]|[A-Z]{2}[a-z]"), "identifier")
        .otherwise("word")
    )


def run_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per run, with the columns of ``docs`` but the text: raw, kind and token, which has no trailing punctuation
    unless it is a number; runs of punctuation alone are gone.

    The runs are rows before anything is decided on them, so that each kind is found once, in compiled code.
    """
    others = [c for c in docs.columns if c != text]
    runs = docs.select(*others, F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), 0)).alias("raw"))
    kinds = runs.withColumn("kind", token_kind(F.col("raw")))
    # only a last sign can be trailing punctuation
    tail = F.substring("raw", -1, 1).isin(*".:,;!?") & (F.col("kind") != "number")
    return kinds.withColumn("token", F.when(tail, F.regexp_replace("raw", TRAILING, "")).otherwise(F.col("raw"))).where("token <> ''")


def standard_token_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per standard token, in the column term: runs in lower case and the parts of identifiers."""
    runs = run_rows(docs, text)
    none = F.array().cast("array<string>")
    parts = F.when(F.col("kind") == "identifier", identifier_parts(F.col("token"))).otherwise(none)
    others = [c for c in runs.columns if c not in ("raw", "kind", "token")]
    return runs.select(*others, F.explode(F.concat(F.array(ascii_lower(F.col("token"))), parts)).alias("term"))


def standard_runs(text: Column) -> Column:
    """Array of (raw, token, kind): runs, without trailing punctuation unless they are numbers; empty ones are gone."""
    runs = F.coalesce(F.regexp_extract_all(text, F.lit(RUN), 0), F.array().cast("array<string>"))
    kinds = F.transform(runs, lambda r: F.struct(r.alias("raw"), token_kind(r).alias("kind")))
    made = F.transform(kinds, lambda m: F.struct(m["raw"].alias("raw"), F.when(m["kind"] == "number", m["raw"]).otherwise(F.regexp_replace(m["raw"], TRAILING, "")).alias("token"), m["kind"].alias("kind")))
    return F.filter(made, lambda m: m["token"] != "")


def identifier_parts(token: Column) -> Column:
    """Parts of an identifier, split at _ - . : and at changes of case; none for flags and for tokens of one part."""
    parts = F.filter(F.split(token, PARTS), lambda p: p != "")
    lowered = F.transform(parts, ascii_lower)
    return F.when(token.rlike("^--?[A-Za-z]"), F.array().cast("array<string>")).when((F.size(lowered) == 1) & (lowered[0] == ascii_lower(token)), F.array().cast("array<string>")).otherwise(lowered)


def standard_tokens(text: Column) -> Column:
    """All tokens of a text in order: each run in lower case, an identifier's parts behind it."""
    return F.flatten(F.transform(standard_runs(text), lambda m: F.concat(F.array(ascii_lower(m["token"])), F.when(m["kind"] == "identifier", identifier_parts(m["token"])).otherwise(F.array().cast("array<string>")))))
