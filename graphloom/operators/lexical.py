"""Lexical search: any-term matching of stemmed terms, ranked by BM25 (Robertson and Zaragoza, 2009)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.operators.knn import least
from graphloom.sources.shared import stored

STOP = tuple("the and for that with was were are this from have has had not but you your our his her its they them their which who will would can been being there what when where how all any".split())
STEM = r"^(.{3,}?)(?:ing|edly|ed|es|s|ly)$"
K1, B = 1.2, 0.75
#: Terms of queries that are sent to every task; queries and items that are scored at a time; words whose endings a task remembers.
TERMS, QUERIES, ITEMS, MEMO = 1 << 20, 256, 1024, 1 << 20
HITS = "id bigint, length bigint, terms array<int>, tfs array<int>, met bigint"
WHOLE = ("bigint", "int", "smallint", "tinyint")
HIT_NAMES = ["id", "length", "terms", "tfs", "met"]


def plain_words(c: Column) -> Column:
    """Terms of a text before their endings go."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def stemmed(c: Column) -> Column:
    """Terms of a text, stop words out, common English endings off; repeats stay."""
    return F.transform(plain_words(c), lambda w: F.regexp_replace(w, STEM, "$1"))


def inverted(items: DataFrame, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): how often each term is in each item, and how many terms the item has; of the terms of ``only`` (term) if given, which come before anything is counted."""
    rows = items.select("id", stemmed(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    rows = rows.select("id", "length", F.explode("words").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def search(queries: DataFrame, items: DataFrame, k: int = 50, text: str = "text", question: str = "text", *, most_terms: int = TERMS) -> DataFrame:
    """The k best items (id, text) of each query (query_id, text): (query_id, id, score, rank). An item scores if, and only if, it has a term of the query; ties by id, which is one item's alone.

    Counts and lengths cover all items, those without terms included. Up to ``most_terms`` terms of queries go to every task: items are split into terms once, those of the queries are stored, and every
    task keeps k of its items for each query, so that what is shuffled does not grow with the matches. Beyond that, terms are joined.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(stemmed(F.col(question)))).alias("term"))
    whole = dict(asked.dtypes)["query_id"] in WHOLE and dict(items.dtypes)["id"] in WHOLE
    few = asked.limit(most_terms + 1).toArrow() if whole else None
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    scored = _joined(asked, items, text) if few is None or len(few) > most_terms else _scanned(few, items, k, text, dict(asked.dtypes)["query_id"])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _joined(asked: DataFrame, items: DataFrame, text: str) -> DataFrame:
    stats = items.select(F.size(stemmed(F.col(text))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hit = inverted(items, text, asked.select("term").distinct())
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    both = asked.join(hit, "term").join(df, "term").crossJoin(F.broadcast(stats))  # one row; its size never grows
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(gain), 6).alias("score"))


def _scanned(asked: pa.Table, items: DataFrame, k: int, text: str, kind: str) -> DataFrame:
    spark = items.sparkSession
    names = sorted(set(asked["term"].to_pylist()))
    number = {t: i for i, t in enumerate(names)}
    told, query = np.unique(asked["query_id"].to_numpy(), return_inverse=True) if len(asked) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    term = np.array([number[t] for t in asked["term"].to_pylist()], np.int64)
    if not len(term):
        return spark.createDataFrame([], f"query_id {kind}, id bigint, score double")
    terms_ = spark.sparkContext.broadcast(number)
    ending = re.compile(STEM)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's terms that are asked for; an id of None tells how many items, and how many terms, a task has met."""
        number, known, met, total = terms_.value, {}, 0, 0
        for batch in batches:
            ids, words = batch.columns
            ends = words.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            flat = words.flatten().dictionary_encode()
            met, total = met + len(ids), total + len(flat)
            if len(known) > MEMO:
                known.clear()
            of = []
            for w in flat.dictionary.to_pylist():
                if w not in known:
                    known[w] = number.get(ending.sub(r"\1", w), -1)
                of.append(known[w])
            at = np.array(of or [-1], np.int64)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(ends))[at >= 0]
            key, tf = np.unique(row * len(number) + at[at >= 0], return_counts=True)
            row, at = key // len(number), key % len(number)
            one, size = np.unique(row, return_counts=True)
            if len(one):
                lists = lambda x: pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(x, pa.int32()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(one)), pa.array(np.diff(ends)[one]), lists(at), lists(tf), pa.nulls(len(one), pa.int64())], names=HIT_NAMES)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([met])], names=HIT_NAMES)

    words = items.select(F.col("id").cast("bigint").alias("id"), plain_words(F.col(text)).alias("words"))
    found = stored(words.mapInArrow(hits, HITS))
    n, total = found.where("id is null").agg(F.sum("met"), F.sum("length")).first()
    found = found.where("id is not null")
    count = np.zeros(len(names))
    for t, df in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
        count[t] = df
    idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
    mean = total / n if n else 1.0
    held = spark.sparkContext.broadcast((told, query, term, idf))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, query, term, idf = held.value
        start = np.searchsorted(query, np.arange(0, len(told) + QUERIES, QUERIES)) if (np.diff(query) >= 0).all() else None
        if start is None:
            by = np.argsort(query, kind="stable")
            query, term = query[by], term[by]
            start = np.searchsorted(query, np.arange(0, len(told) + QUERIES, QUERIES))
        got: dict[int, tuple] = {}
        for batch in batches:
            for a in range(0, len(batch), ITEMS):
                ids, length, terms_of, tfs, _ = batch.slice(a, ITEMS).columns
                ids, length = ids.to_numpy(), length.to_numpy().astype(np.float64)
                row, at, tf = np.repeat(np.arange(len(ids)), np.diff(terms_of.offsets.to_numpy())), terms_of.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.float64)
                gain = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
                for b in range(len(start) - 1):
                    q, t = query[start[b] : start[b + 1]] - b * QUERIES, term[start[b] : start[b + 1]]
                    own = np.unique(t)
                    place = np.searchsorted(own, at).clip(0, len(own) - 1)
                    mine = own[place] == at
                    each = np.zeros((len(ids), len(own)))
                    each[row[mine], place[mine]] = gain[mine]
                    wanted = np.zeros((len(own), min(QUERIES, len(told) - b * QUERIES)))
                    wanted[np.searchsorted(own, t), q] = 1.0
                    score = each @ wanted
                    if b in got and len(ids) > 0:  # what is below the last of k so far cannot count
                        low = score >= got[b][3][None, :] - 1e-6
                    elif len(ids) > k:
                        low = score >= np.partition(score, -k, axis=0)[-k] - 1e-6
                    else:
                        low = np.ones_like(score, bool)
                    i, j = np.nonzero((score > 0) & low)
                    new = (j, ids[i], -np.round(score[i, j], 6))
                    kept = least(*((np.concatenate(p) for p in zip(got[b][:3], new, strict=True)) if b in got else new), k)
                    floor = np.zeros(wanted.shape[1])
                    last = np.flatnonzero(np.r_[kept[0][1:] != kept[0][:-1], True]) if len(kept[0]) else np.zeros(0, np.int64)
                    full = np.diff(last, prepend=-1) == k
                    floor[kept[0][last[full]]] = -kept[2][last[full]]
                    got[b] = (*kept, floor)
        for b, (j, ids, d, _) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array(told[j + b * QUERIES], pa.int64()), pa.array(ids, pa.int64()), pa.array(-d, pa.float64())], names=["query_id", "id", "score"])

    out = found.mapInArrow(best, "query_id bigint, id bigint, score double")
    return out.withColumn("query_id", F.col("query_id").cast(kind))


def matches(c: Column, words: list[str]) -> Column:
    """Whether a text has any of the terms, unstemmed."""
    return F.arrays_overlap(terms(c), F.array(*map(F.lit, words))) if words else F.lit(False)
