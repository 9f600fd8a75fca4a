from pyspark.sql import functions as F

from siltstone.functions.text import ascii_lower, bow_tokens, identifier_parts, space_terms, standard_runs, standard_tokens


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_standard_tokens(spark):
    assert one(spark, "HTTPServer", standard_tokens) == ["httpserver", "http", "server"]
    assert one(spark, "Hello ENGINE_HAS_STORE error 11001", standard_tokens) == ["hello", "engine_has_store", "engine", "has", "store", "error", "11001"]
    assert one(spark, "...", standard_tokens) == []
    assert one(spark, "-Wall --flag", standard_tokens) == ["-wall", "--flag"]
    assert one(spark, "docs/readme.md.", standard_tokens) == ["docs/readme.md"]
    assert one(spark, None, standard_tokens) == []


def test_kinds_are_decided_before_trimming(spark):
    rows = one(spark, "end. 3. a/b x:y", standard_runs)
    assert [(r["token"], r["kind"]) for r in rows] == [("end", "identifier"), ("3.", "number"), ("a/b", "path"), ("x:y", "identifier")]


def test_long_runs_do_not_overflow(spark):
    assert len(one(spark, "a" * 200_000, standard_tokens)) == 1


def test_bow_tokens_lower_ascii_only(spark):
    assert one(spark, "alpha-beta-gamma É a B2", bow_tokens) == ["alpha", "beta", "gamma", "b2"]
    assert one(spark, "ÉA", ascii_lower) == "Éa"
    assert one(spark, None, bow_tokens) == []


def test_space_terms_keep_case_and_fall_back(spark):
    assert one(spark, " Foo  bar\tBaz", space_terms) == ["Foo", "bar", "Baz"]
    assert one(spark, "  ", space_terms) == ["  "]


def test_identifier_parts(spark):
    assert one(spark, "parseXMLDoc2Go", identifier_parts) == ["parse", "xml", "doc2", "go"]
    assert one(spark, "word", identifier_parts) == []
