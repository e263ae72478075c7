"""Packing of documents into training sequences by vector best-fit.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths, as attention stays within a document).
Pieces come by falling length; each goes to the open bin that has room under every capacity and scores best: the least
weighted norm of what would remain, or the greatest weighted dot product of need and residual. A new bin opens only where none has room.

Pieces are dealt by hash to shards of about ``SHARD`` pieces that are packed apart: their number follows the input, and a shard's loss is a few
bins at its end. Only ids and lengths travel; texts do not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import cut, doc_texts, table

MOST_TOKENS = 8192
MOST_DOCS = 64
#: A longer document is cut into pieces of this length.
PIECE = 4096
MOST_ATTENTION = 3 * PIECE * PIECE // 2
WEIGHTS = (1.0, 0.25, 0.5)
SHARD = 4096
OUT = "shard int, bin int, slot int, doc_id bigint, piece int, first_token bigint, n_tokens bigint, bin_tokens bigint, bin_docs int, bin_attention bigint"


def word_count(text: Column) -> Column:
    """White-space-separated words; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The bin of each piece, in the order given. Ties go to the bin opened first."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule must be norm or dot, not {rule!r}")
    top = np.asarray(capacity, np.float64)
    w = np.asarray(weights, np.float64)
    left = np.empty((64, 3), np.int64)
    used = 0
    open_bins = np.zeros(64, np.int64)
    live = 0
    out = np.empty(len(lengths), np.int64)
    # Lengths only fall, so a bin too full for the least piece to come is closed for good.
    least = np.minimum.accumulate(lengths[::-1])[::-1] if len(lengths) else lengths
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1, n * n], np.int64)
        if i % 256 == 0 and live:
            floor = np.array([least[i], 1, least[i] ** 2])
            keep = (left[open_bins[:live]] >= floor).all(1)
            kept = open_bins[:live][keep]
            live = len(kept)
            open_bins[:live] = kept
        rows = open_bins[:live]
        room = left[rows] - need
        fits = np.flatnonzero((room >= 0).all(1))
        if len(fits):
            if rule == "norm":
                score = ((room[fits] / top) ** 2 * w).sum(1)
                b = rows[fits[score.argmin()]]
            else:
                score = (left[rows[fits]] / top * (need / top) * w).sum(1)
                b = rows[fits[score.argmax()]]
        else:
            if used == len(left):
                left = np.concatenate([left, np.empty_like(left)])
                open_bins = np.concatenate([open_bins, np.zeros_like(open_bins)])
            left[used] = capacity
            b = open_bins[live] = used
            used += 1
            live += 1
        left[b] -= need
        out[i] = b
    return out


def pack(docs: DataFrame, tokens: Column | None = None, capacity: tuple[int, int, int] = (MOST_TOKENS, MOST_DOCS, MOST_ATTENTION), piece: int = PIECE, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """One row for each piece: its (shard, bin, slot), its document, its range of tokens, and the totals of its bin.

    tokens: a count over the column ``text``; white-space-separated words by default.

    * Null and empty texts have no tokens and take no place. A null doc_id is packed like any other.
    * A document longer than ``piece`` becomes consecutive pieces of that length and a rest, so no text is too long.
    * Repeated rows are packed each. Pieces of equal length are ordered by doc_id (nulls first), then piece; equal scores go to the bin opened first.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if min(capacity) < 1 or piece > capacity[0] or piece * piece > capacity[2]:
        raise ValueError("a full piece must fit an empty bin under every capacity")
    count = word_count(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")
    rows = doc_texts(docs).select("doc_id", count.alias("n")).where("n > 0")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / piece).cast("int"))).alias("piece"))
    pieces = cut(pieces.select("doc_id", "piece", (F.col("piece").cast("bigint") * piece).alias("first_token"), F.least(F.col("n") - F.col("piece").cast("bigint") * piece, F.lit(piece)).alias("n_tokens")))
    shards = max(1, -(-pieces.count() // shard))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")], null_placement="at_start"))
        n = rows["n_tokens"].to_numpy()
        where = best_fit(n, capacity, weights, rule)
        order = np.argsort(where, kind="stable")
        slot = np.empty(len(n), np.int64)
        slot[order] = np.arange(len(n)) - np.searchsorted(where[order], where[order])
        total, docs_in, cost = (np.bincount(where, w).astype(np.int64)[where] for w in (n, None, n * n))
        new = {"bin": (where, pa.int32()), "slot": (slot, pa.int32()), "bin_tokens": (total, pa.int64()), "bin_docs": (docs_in, pa.int32()), "bin_attention": (cost, pa.int64())}
        cols = {c: rows[c] for c in ("shard", "doc_id", "piece", "first_token", "n_tokens")} | {c: pa.array(v, k) for c, (v, k) in new.items()}
        return pa.table({c: cols[c] for c in ("shard", "bin", "slot", "doc_id", "piece", "first_token", "n_tokens", "bin_tokens", "bin_docs", "bin_attention")})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(one, OUT)


def op2_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
