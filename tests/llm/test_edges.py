"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator over documents or pages."""

import functools
import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, fingerprints, html_text, language_id, licenses, media, ngram_join, packing, pii, token_rollups
from tests.llm.helpers import clashing, docs, rows

LONG = "the quick brown fox jumps over the lazy dog and writes to a.b@example.com. Licensed under CC BY 4.0. " * 2000
TEXTS = ["the first of all texts is here. All rights reserved.", None, "", "   \n", LONG, "mail x@y.org now", "12345 !!", "ein Text \U0001f600 mit é und ü"]


@functools.cache
def _fixed(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def fixed(df):
    """A model that does not depend on the rows it is used on."""
    return _fixed(df.sparkSession)


def model(df):
    return language_id.fit(df)


OPERATORS = {
    "pii": lambda df: pii.find(df),
    "packing": lambda df: packing.pack(df),
    "bpe": lambda df: bpe.encode(df),
    "fingerprints": lambda df: fingerprints.compare(df),
    "licenses": lambda df: licenses.scan(df),
    "rollups": lambda df: token_rollups.document_changes(df),
    "ngram": lambda df: ngram_join.jaccard_pairs(df),
    "classes": lambda df: ngram_join.similarity_classes(df),
    "language": lambda df: language_id.identify(df, fixed(df)),
    "filter": lambda df: language_id.keep_accepted(df, language_id.fit(df)).select("doc_id", "text"),
    "unique": lambda df: ngram_join.keep_one_per_group(df).select("doc_id", "text"),
    "redact": lambda df: pii.redact_documents(df).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    run = OPERATORS[name]
    plain = docs(spark, *TEXTS)
    want = rows(run(plain))
    assert rows(run(clashing(plain))) == want, "other columns matter"
    assert run(plain.where("false")).count() == 0, "rows out of nothing"
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "some text with words", None, None, None)], plain.schema)
    run(plain.unionByName(nulls)).collect()
    run(nulls).collect()
    twice = rows(run(plain.unionByName(plain)))
    assert set(want) <= set(twice) or name in ("packing", "rollups")
    if name in ("ngram", "classes", "fingerprints"):
        assert twice == want, "a repeated row is one document"
    elif name not in ("packing",):
        assert len(twice) == 2 * len(want)


BIG = [None, 2**53 + 1, 2**63 - 1, -(2**63), 7]


def keyed(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(BIG, texts, strict=True)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_64_bits_beside_nulls(spark, name):
    """Every row finds something in every text, and all ids come back as they were."""
    words = "the old man and the sea were at the house, write to a.b@example.org. All rights reserved. "
    df = keyed(spark, [words + x for x in ("alpha", "beta", "gamma", "delta", "alpha")])
    out = OPERATORS[name](df)
    ids = [c for c in out.columns if c in ("doc_id", "doc_a", "doc_b")]
    got = {r[c] for r in out.select(*ids).collect() for c in ids}
    whole = set(BIG) if name not in ("ngram", "classes", "fingerprints", "unique") else {None, -(2**63)} if name == "unique" else set(BIG) - {None}
    assert got == whole


def test_page_ids_of_64_bits_beside_nulls(spark):
    df = spark.createDataFrame([(i, "<p>x<img src='data:,card'>") for i in BIG], "page_id bigint, html string").coalesce(1)
    assert {r["page_id"] for r in html_text.extract(df).collect()} == set(BIG)
    store = spark.createDataFrame([(hashlib.sha256(b"card").hexdigest(), bytearray(b"card"))], "digest string, payload binary")
    assert {(r["page_id"], r["n_resolved"]) for r in media.resolve(df, store).collect()} == {(i, 1) for i in BIG}


def test_pipeline_edges(spark):
    """Nulls, empty and long texts, repeated rows, large ids and an empty table, through all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = "the old man and the sea were at the house of the north wind "
    plain = keyed(spark, [words, words + "mail x@y.org now", "", "12345 !!", words * 3000]).unionByName(docs(spark, None, words, words))

    def through(df):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
        return df

    got = through(plain)
    assert {r["doc_id"] for r in got.collect()} == {None, 2}  # of ids 2 (twice the same text), 3, 7 and 2**53 + 1 the least is 2
    twice = through(plain.unionByName(plain))
    assert sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in twice.collect()) == sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in got.collect() for _ in range(2))
    assert through(plain.where("false")).count() == 0


def test_pages_edges(spark):
    html = "<p>a</p>" * 30000
    df = spark.createDataFrame([(1, "<h1>T</h1>"), (2, None), (3, ""), (None, "<p>x"), (4, html), (1, "<h1>T</h1>"), (5, "<div>" * 5000 + "deep")], "page_id bigint, html string")
    got = {r[0]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == "T" and not got[2]["text"] and not got[3]["text"] and got[None]["text"] == "x" and got[4]["text"].count("a") == 30000 and got[5]["text"] == "deep"
    assert html_text.extract(df).count() == 7 and html_text.extract(df.where("false")).count() == 0
    assert rows(html_text.extract(clashing(df))) == rows(html_text.extract(df))
    none = spark.createDataFrame([], "digest string, payload binary")
    res = media.resolve(df, none)
    assert res.count() == 7 and {r["n_media"] for r in res.collect()} == {0}
    assert media.resolve(df.where("false"), none).count() == 0
    assert rows(media.resolve(clashing(df), none)) == rows(res)


def test_columns_of_documents_stay(spark):
    df = docs(spark, *TEXTS)
    for out in (language_id.keep_accepted(df, model(df)), ngram_join.keep_one_per_group(df), pii.redact_documents(df)):
        assert out.schema.simpleString() == df.schema.simpleString()
    assert pii.redact_documents(df).where("text is null").count() == 1
    assert pii.redact_documents(df).where(F.col("n_chars") != F.length("text")).count() == 0
