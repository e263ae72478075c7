"""Ordering and merging of retrieved triples.

Rows carry ``query_id`` and ``pos``, their place in the list so far; every operator here partitions by ``query_id`` and gives a new ``pos``, counted from 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import terms, token_estimate

SAME_ENDS = 0.6


def key() -> list[Column]:
    """Two triples are one if source, predicate and target agree in lower case."""
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("src_id", "relation_type", "tgt_id")]


def _numbered(triples: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return triples.withColumn("pos", F.row_number().over(w).cast("bigint"))


def dedupe(triples: DataFrame) -> DataFrame:
    """Of equal triples the first stays."""
    w = Window.partitionBy("query_id", *key()).orderBy("pos")
    return _numbered(triples.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"), F.col("pos"))


def hop_recency(triples: DataFrame) -> DataFrame:
    """Fewest hops first (one where unsaid), then the latest assertion, then the greatest weight, then as they were."""
    hops = F.coalesce("hops", F.lit(1)) if "hops" in triples.columns else F.lit(1)
    return _numbered(triples, hops, F.coalesce("asserted_at", F.lit("")).desc(), F.coalesce("weight", F.lit(1)).desc(), F.col("pos"))


def reciprocal_rank(channels: DataFrame, k: int = 60) -> DataFrame:
    """Channels (query_id, channel, pos, …) fused: a triple scores 1 / (k + rank) in every place where a channel has it.

    The row kept is that of the first channel which has the triple; equal scores are in order of first sighting. One shuffle by query
    for the ranks, one by triple for the sums.
    """
    ranked = channels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("pos")))
    row = F.struct(*[c for c in channels.columns if c != "query_id"])
    fused = ranked.groupBy("query_id", *[c.alias(f"key{i}") for i, c in enumerate(key())]).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min_by(F.struct(row.alias("row"), "rank"), F.struct("channel", "rank")).alias("first"))
    flat = fused.select("query_id", "score", F.col("first.rank").alias("first_rank"), "first.row.*")
    return _numbered(flat, F.desc("score"), F.col("channel"), F.col("first_rank")).drop("first_rank")


def quota_interleave(traversed: DataFrame, seeded: DataFrame, quota: float) -> DataFrame:
    """Two lists with a share of ``quota``, held between 0 and 1, for the second: each place goes to it while it has less than its share; what one has left follows.

    The place of every row follows from its number alone, so this is two window functions and a sort, without a loop.
    """
    q = min(1.0, max(0.0, quota))
    last = F.lit(2.0**60)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("double")
    a = traversed.withColumn("n", n).withColumn("place", (F.ceil(F.col("n") / (1 - q)).cast("double") if q < 1 else last) if q > 0 else F.col("n"))
    b = seeded.withColumn("n", n).withColumn("place", (F.floor((F.col("n") - 1) / q).cast("double") + 1) if q > 0 else last)
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(0)), allowMissingColumns=True)
    return _numbered(both, F.col("place"), F.col("side"), F.col("n")).drop("place", "side", "n")


def keyword_rank(triples: DataFrame, keywords: Column, most: int) -> DataFrame:
    """By how many of the keywords a triple's text holds, then by weight; the first ``most``."""
    text = F.lower(F.concat_ws(" ", "src_id", "tgt_id", "relation_type", "description"))
    words = F.filter(F.transform(keywords, lambda w: F.lower(w)), lambda w: w != "")
    scored = triples.withColumn("hits", F.size(F.filter(words, lambda w: F.contains(text, w))))
    return _numbered(scored, F.desc("hits"), F.coalesce("weight", F.lit(1)).desc(), F.col("pos")).where(F.col("pos") <= most)


def token_budget(items: DataFrame, budget: int, text: str = "line") -> DataFrame:
    """Items in order until the first that would pass the budget; a later one that fits does not slip in. Costs are one at least, so the running sum decides."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(token_estimate(F.col(text)).cast("bigint")).over(w)).where(F.col("running") <= budget)


def triple_terms() -> Column:
    return terms(F.concat_ws(" ", "src_id", "relation_type", "tgt_id", "description"))


def redundancy(a: Column, b: Column) -> Column:
    """How far two triples (structs src_id, tgt_id, terms) say the same: overlap of terms over union, at least SAME_ENDS where both ends agree."""
    joint = F.size(F.array_union(a["terms"], b["terms"]))
    share = F.when(joint > 0, F.size(F.array_intersect(a["terms"], b["terms"])) / joint).otherwise(0.0)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    ends = (low(a["src_id"]) != "") & (low(a["src_id"]) == low(b["src_id"])) & (low(a["tgt_id"]) == low(b["tgt_id"]))
    return F.greatest(share, F.when(ends, SAME_ENDS).otherwise(0.0))


def _likeness(words: list[set[str]], ends: list[tuple[str, str]], dense: int) -> Callable[[int], np.ndarray]:
    """How far each item of a list says the same as a given one: rows of a matrix for lists of up to ``dense`` items, which is computed at once; for longer ones each row by itself, so that no matrix is held."""
    n = len(words)
    size = np.array([len(w) for w in words], np.float64)
    codes: dict[tuple[str, str], int] = {}
    end = np.array([codes.setdefault(e, len(codes)) if e[0] else -1 - i for i, e in enumerate(ends)], np.int64)
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(x, len(number)) for w in words for x in w], np.int64)
    item = np.repeat(np.arange(n), size.astype(np.int64))

    def share(both: np.ndarray, i: int | slice) -> np.ndarray:
        joint = size[i, None] + size - both if isinstance(i, slice) else size[i] + size - both
        out = np.divide(both, joint, out=np.zeros(both.shape), where=joint > 0)
        return np.where(end == (end[i, None] if isinstance(i, slice) else end[i]), np.maximum(out, SAME_ENDS), out)

    if n <= dense:
        held = np.zeros((n, len(number)))
        held[item, flat] = 1
        rows = share(held @ held.T, slice(None))
        return lambda i: rows[i]
    by = np.argsort(flat, kind="stable")
    places = np.split(item[by], np.cumsum(np.bincount(flat, minlength=len(number)))[:-1]) if len(flat) else []
    first = np.r_[0, np.cumsum(size.astype(np.int64))]
    return lambda i: share(np.bincount(np.concatenate([places[x] for x in flat[first[i] : first[i + 1]]]), minlength=n).astype(np.float64) if size[i] else np.zeros(n), i)


def mmr_order(words: list[set[str]], ends: list[tuple[str, str]], trade: float, dense: int = 512) -> list[int]:
    """Greedy maximal marginal relevance (Carbonell and Goldstein, 1998) over a list in order of relevance; ties go to the earlier item."""
    n, out = len(words), []
    like = _likeness(words, ends, dense)
    base = trade * (1 - np.arange(n) / max(n, 1))
    worst = np.zeros(n)
    for _ in range(n):
        best = int(np.argmax(base - (1 - trade) * worst))
        base[best] = -np.inf
        out.append(best)
        np.maximum(worst, like(best), out=worst)
    return out


def diversify(triples: DataFrame, trade: float) -> DataFrame:
    """Reordered by maximal marginal relevance, nothing dropped. ``trade`` of 1 or more changes nothing; below 0 it is 0.

    A query's merged list is bounded by the channels' caps, so a list is one call of the kernel, and queries spread over tasks.
    """
    if trade >= 1:
        return triples
    cols = triples.columns
    schema = triples.schema

    def ordered(t: pa.Table, starts: list[int]) -> pa.RecordBatch:
        words = t["terms"].to_pylist()
        ends = list(zip(*([(x or "").lower() for x in t[c].to_pylist()] for c in ("src_id", "tgt_id")), strict=True))
        order, pos = [], []
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            order += [a + i for i in mmr_order([set(w) for w in words[a:b]], ends[a:b], max(0.0, trade))]
            pos += range(1, b - a + 1)
        t = t.select(cols).take(pa.array(order, pa.int64()))
        at = cols.index("pos")
        return t.set_column(at, t.schema.field(at), pa.array(pos, t.schema.field(at).type)).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group by itself costs more than its order; so lists lie one after the other, and the last of a batch waits for its rest
        waiting, last = [], object()
        for batch in batches:
            ids = batch["query_id"].to_pylist()
            starts = [i for i in range(len(ids)) if ids[i] != (ids[i - 1] if i else last)]
            if waiting and starts:
                waiting.append(batch.slice(0, starts[0]))
                yield ordered(pa.Table.from_batches(waiting), [0])
                waiting = []
            if len(starts) > 1:
                yield ordered(pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])]), [i - starts[0] for i in starts[:-1]])
            if ids:
                waiting.append(batch.slice(starts[-1]) if starts else batch)
                last = ids[-1]
        if waiting:
            yield ordered(pa.Table.from_batches(waiting), [0])

    rows = triples.withColumn("terms", triple_terms())
    return rows.repartition("query_id").sortWithinPartitions("query_id", "pos").mapInArrow(run, schema)


def nearest_first(triples: DataFrame, distances: DataFrame) -> DataFrame:
    """By the lesser distance (query_id, node, dist) of the two ends; those not reached come after all that were; without distances nothing changes."""
    most = distances.groupBy("query_id").agg(F.max("dist").alias("most"))
    ends = lambda c, d: distances.select("query_id", F.col("node").alias(c), F.col("dist").alias(d))
    both = triples.join(ends("src_key", "src_dist"), ["query_id", "src_key"], "left").join(ends("tgt_key", "tgt_dist"), ["query_id", "tgt_key"], "left").join(most, "query_id", "left")
    far = F.coalesce(F.least("src_dist", "tgt_dist"), F.col("most") + 1, F.lit(0))
    return _numbered(both.withColumn("far", far), F.col("far"), F.col("pos")).select(*triples.columns)
