"""Language identification as inference of a mixture of languages in each document.

Every word is drawn from one language; a language's likelihood of a word is the product of its character trigrams'. Expectation-
maximisation estimates each document's proportions over all languages and a background ("und", uniform over all
buckets of trigrams, which explains keys, hashes and noise, but never what any language has seen more often than chance). Then the language set is chosen by penalised likelihood (BIC): sets grow in the order of
the proportions, each with proportions of its own, and the best penalised one stays.

The trigram models are fitted on a bounded sample of labelled rows (``per_language`` documents of each language, those whose
doc_id hashes lowest); inference covers all documents and whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import alnum_table, arrow_batches, chunks, code_points, doc_texts, pandas_batches, table, temp_name, word_spans

PER_LANGUAGE = 400
BUCKETS = 1 << 16
SMOOTHING = 0.1
ROUNDS = 12
#: Nats a further language must bring, in units of BIC's half log n.
PENALTY = 1.0
#: A document whose background proportion is above this has no language, if languages alone explain it worse by at least EVIDENCE nats: a likelihood
#: ratio of e**10, whatever the length, so that a few rare words do not condemn a short text.
MOST_BACKGROUND = 0.5
EVIDENCE = 10.0
BACKGROUND = "und"


@functools.cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of words: one centred on each letter, a blank beyond a word's end; the first of each word; the first word of each text.

    A word is a run of letters and digits with a letter: numbers say nothing about language, and keys and hashes speak for the background.
    """
    cp, starts = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    begins, ends, _ = word_spans(cp, starts, alnum_table())
    letters = np.concatenate([[0], np.cumsum(letter_table()[cp])])
    some = letters[begins] < letters[ends]
    begins, ends = begins[some], ends[some]
    words = np.searchsorted(begins, starts)
    length = ends - begins
    first = np.cumsum(length) - length
    at = np.repeat(begins - first, length) + np.arange(int(length.sum()))
    c = cp[at].astype(np.uint32)
    left, right = np.empty_like(c), np.empty_like(c)
    if len(c):
        left[1:], left[first] = c[:-1], 32
        right[:-1], right[first + length - 1] = c[1:], 32
        left[0] = 32
        right[-1] = 32
    h = (left * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.uint16), first, words


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, _ in pandas_batches(batches):
        for lang, own in pdf.groupby("lang"):
            n = np.bincount(trigrams(own["text"].tolist())[0], minlength=BUCKETS)
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": n[seen]})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets under each, the background last."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r[0] for r in rows.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id").collect()]
    if not ids:
        return [], np.zeros((BUCKETS, 1), np.float32)
    sample = doc_texts(docs, "doc_id", "text", "lang").where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    counts = sample.mapInPandas(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return [], np.zeros((BUCKETS, 1), np.float32)
    n = np.zeros((BUCKETS, len(langs)))
    n[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)})] = counts["n"]
    seen = max(2, np.count_nonzero(n.sum(1)))
    logs = np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * seen))
    return langs, np.concatenate([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))], 1).astype(np.float32)


def _em(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's allowed components, and its log likelihood. ll: words by components; no document is empty."""
    top = ll.max(1, keepdims=True)
    p = np.exp(ll - top)
    at, size = first[:-1], np.diff(first)
    share = allowed / allowed.sum(1, keepdims=True).astype(np.float32)
    for k in range(rounds + 1):
        r = p * np.repeat(share, size, axis=0)
        total = np.maximum(r.sum(1, keepdims=True), np.float32(1e-35))
        if k < rounds:
            r /= total
            share = (np.add.reduceat(r, at, axis=0) / size[:, None]).astype(np.float32)
    return share, np.add.reduceat(np.log(total[:, 0]).astype(np.float64) + top[:, 0], at)


def infer(texts: list[str], langs: list[str], logs: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> list[tuple]:
    """(languages, proportions, words, log likelihood, evidence) of each text, languages by falling proportion, ties by name.

    ``evidence``: by how much the log likelihood exceeds that of all languages without the background, where the set has it; else 0.
    """
    names = [*langs, BACKGROUND]
    gram, word, first = trigrams(texts)
    out: list[tuple] = [([], [], 0, 0.0, 0.0)] * len(texts)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if not len(full) or not langs:
        return [([], [], int(n), 0.0, 0.0) for n in size]
    ll = np.add.reduceat(logs[gram], word, axis=0)
    first = np.concatenate([first[:-1][full], first[-1:]])
    size = size[full]
    share, best = _em(ll, first, np.ones((len(full), len(names)), np.bool_), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    one = np.add.reduceat(ll, first[:-1], axis=0, dtype=np.float64)
    chosen = np.zeros(share.shape, np.float32)
    cost = penalty * 0.5 * np.log(size + 1)
    alone = one.max(1)
    chosen[np.arange(len(full)), one.argmax(1)] = 1
    like = alone.copy()
    score = alone.copy()
    # No set is likelier than all together: only where that pays for a second language are larger sets tried.
    todo = np.flatnonzero(best - alone > cost)
    for k in range(2, len(names) + 1):
        if not len(todo):
            break
        pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in todo])
        sub = np.concatenate([[0], np.cumsum(size[todo])])
        allowed = np.zeros((len(todo), len(names)), np.bool_)
        np.put_along_axis(allowed, order[todo, :k], True, axis=1)
        own, l = _em(ll[pick], sub, allowed, rounds)
        better = l - (k - 1) * cost[todo] > score[todo]
        d = todo[better]
        chosen[d], like[d], score[d] = own[better], l[better], (l - (k - 1) * cost[todo])[better]
        todo = todo[best[todo] - k * cost[todo] > score[todo]]
    evidence = np.zeros(len(full))
    if len(odd := np.flatnonzero(chosen[:, -1] > 0)):
        pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in odd])
        allowed = np.ones((len(odd), len(names)), np.bool_)
        allowed[:, -1] = False
        evidence[odd] = like[odd] - _em(ll[pick], np.concatenate([[0], np.cumsum(size[odd])]), allowed, rounds)[1]
    for row, d in enumerate(full):
        got = sorted(((-round(float(x), 4), names[i]) for i, x in enumerate(chosen[row]) if x >= 5e-5))
        out[d] = [n for _, n in got], [-x for x, _ in got], int(size[row]), round(float(like[row]), 2), float(evidence[row])
    return out


def accepts(found: tuple, most_background: float = MOST_BACKGROUND) -> bool:
    """Whether a result of ``infer`` is a text in some language."""
    languages, proportions, words, _, evidence = found
    return words > 0 and (evidence < EVIDENCE or dict(zip(languages, proportions, strict=True)).get(BACKGROUND, 0) <= most_background)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], most_background: float = MOST_BACKGROUND) -> DataFrame:
    """(doc_id, languages, proportions, primary, n_words, log_likelihood, accepted) of every row of ``docs``.

    * A null or empty text, or one without letters, has no languages (empty lists, null primary) and is not accepted.
    * ``languages`` may include "und", the background; a document with more than ``most_background`` of it, on EVIDENCE nats, is not accepted, however short.
    * Equal proportions are ordered by name. Repeated rows each get their result; a null doc_id stays null.
    * Without any labelled row there is no model: lists are empty and every text with letters is accepted.
    * Texts of any length count whole; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_batches(batches):
            got = infer(texts, langs, shared.value)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.list_(pa.float64())),
                pa.array([g[0][0] if g[0] else None for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.float64()),
                pa.array([accepts(g, most_background) for g in got], pa.bool_()),
            ], ["doc_id", "languages", "proportions", "primary", "n_words", "log_likelihood", "accepted"])

    return doc_texts(docs).mapInArrow(run, "doc_id bigint, languages array<string>, proportions array<double>, primary string, n_words int, log_likelihood double, accepted boolean")


def keep_accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], most_background: float = MOST_BACKGROUND) -> DataFrame:
    """The rows of ``docs`` whose text is accepted (see ``identify``), all columns as they are: a filter in one pass, without a join.

    Null and empty texts go, as do those without a letter; rows are judged one by one, so repeated ones share a fate; an empty table stays empty.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def accepted(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        out = []
        for a, b in chunks(texts):
            out += [accepts(g, most_background) for g in infer(texts[a:b], langs, shared.value)]
        return pd.Series(out, dtype=bool)

    accepted.__annotations__ = {"text": pd.Series, "return": pd.Series}
    ok = temp_name("accepted", docs.columns)
    return docs.withColumn(ok, F.pandas_udf(accepted, "boolean")(docs["text"])).where(F.col(ok)).select(docs.columns)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
