"""The pipeline against its stages written plainly, on the smallest documents."""

import pytest

from graphloom.llm import language_id, packing, pii
from tests.llm.helpers import docs
from tests.llm.test_ngram import grams

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain(spark, df):
    model = language_id.fit(df)
    rows = [r for r in df.collect()]
    rows = [r for r, g in zip(rows, language_id.infer([r["text"] or "" for r in rows], *model), strict=True) if language_id.accepts(g)]
    g = {r["doc_id"]: grams(r["text"]) for r in rows}
    least = {i: i for i in g}
    pairs = [(a, b) for a in g for b in g if a < b and g[a] and g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= 0.5]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                moved = True
    texts = {r["doc_id"]: pii.redact(r["text"], pii.fit().decode(r["text"])) for r in rows if least[r["doc_id"]] == r["doc_id"]}
    pieces = []
    for i, t in texts.items():
        n, k = len(t.split()), 0
        while n > 0:
            pieces.append((min(n, packing.PIECE), i, k))
            n, k = n - packing.PIECE, k + 1
    return texts, pieces


def test_pipeline(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts, pieces = plain(spark, df)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["n_tokens"], r["doc_id"], r["piece"]) for r in rows) == sorted(pieces)
    shards = {r["shard"] for r in rows}
    assert shards == {0}, "few pieces are one shard"
    import numpy as np

    order = sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))
    bins = packing.best_fit(np.array([p[0] for p in order]), (packing.MOST_TOKENS, packing.MOST_DOCS, packing.MOST_ATTENTION))
    assert {(r["doc_id"], r["piece"]): r["bin"] for r in rows} == {(p[1], p[2]): b for p, b in zip(order, bins.tolist(), strict=True)}


def test_stages_keep_clean_documents(spark):
    texts = ["the old man and the sea were at the house of the north wind " + w for w in ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "uno due tre quattro cinque sei sette otto nove dieci " * 3)]
    df = docs(spark, *texts, texts[0] + " more", "write to me@example.org about the house of the old north wind")
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
        df.count()
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {1: texts[0], 2: texts[1], 4: "write to [EMAIL] about the house of the old north wind"}
