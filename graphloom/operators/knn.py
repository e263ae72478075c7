"""Exact nearest neighbours by cosine distance, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to every task; more than that are joined block by block.
BROADCAST_BYTES = 64 << 20
BLOCK = 4096
#: Products of vectors' components that a task is meant to do: tasks follow the work, not the bytes of the items.
WORK = 1 << 36
#: Queries whose distances to a block of items are held at a time.
QUERIES = 1024
#: Pairs that are computed in double precision at a time.
CHUNK = 1 << 16
OUT = "query_id bigint, id bigint, distance double"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column of lists, and their norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten(), len(column)
    if n and not flat.null_count and len(flat) % n == 0 and (np.diff(column.offsets.to_numpy()) == len(flat) // n).all():
        m = flat.to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    else:
        m = np.array(column.to_pylist(), np.float64).reshape(n, -1)
    return m, np.sqrt((m * m).sum(1))


def _direction(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0).astype(np.float32)


def least(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row, ties by id."""
    by = np.lexsort((ids, d, row))
    row, ids, d = row[by], ids[by], d[by]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[first], d[first]


class Nearest:
    """The k nearest items so far of each query. Products in single precision tell which pairs may count, with a margin beyond their error; only those are computed in double."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, qn: np.ndarray, k: int) -> None:
        self.qid, self.q, self.qn, self.k = qid, q, qn, k
        self.unit = _direction(q, qn)
        self.margin = np.float32(1e-5 + 4e-7 * q.shape[1])
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.far = np.full(len(qid), np.inf, np.float32)

    def add(self, ids: np.ndarray, x: np.ndarray, xn: np.ndarray) -> None:
        unit = _direction(x, xn)
        for b in range(0, len(self.qid), QUERIES):
            q, qn, far = self.q[b : b + QUERIES], self.qn[b : b + QUERIES], self.far[b : b + QUERIES]
            for at in range(0, len(ids), BLOCK):
                some = slice(at, at + BLOCK)
                near = self.unit[b : b + QUERIES] @ unit[some].T
                floor = 1 - far - self.margin
                if np.isinf(floor).any() and near.shape[1] > self.k:
                    floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k] - self.margin)
                row, col = np.nonzero(near >= floor[:, None])
                if not len(row):
                    continue
                col += at
                scale = qn[row] * xn[col]
                dot = np.concatenate([np.einsum("ij,ij->i", q[row[i : i + CHUNK]], x[col[i : i + CHUNK]]) for i in range(0, len(row), CHUNK)])
                d = np.where(scale > 0, 1.0 - dot / np.where(scale > 0, scale, 1.0), 1.0)
                new = (row, ids[col], np.round(d, 6) + 0.0)  # no negative zeros
                old = self.best.get(b)
                row, of, d = self.best[b] = least(*(new if old is None else (np.concatenate(p) for p in zip(old, new, strict=True))), self.k)
                last = np.flatnonzero(np.r_[row[1:] != row[:-1], True])
                full = np.diff(last, prepend=-1) == self.k
                far[row[last[full]]] = d[last[full]]

    def rows(self) -> pa.RecordBatch:
        got = [(self.qid[b + row], ids, d) for b, (row, ids, d) in self.best.items()]
        a, b, c = (np.concatenate(p) for p in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "distance"])


def spread(items: DataFrame, each: int) -> DataFrame:
    """``items`` in as many partitions as their work takes, if ``each`` is that of one; little work stays where it is."""
    n = -(-items.count() * each // WORK)
    return items.repartition(n) if n > 1 else items


def nearest(queries: DataFrame, items: DataFrame, k: int, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest items (id, embedding) of each query (query_id, embedding): (query_id, id, distance, rank), ties by id.

    Distances are in double precision, rounded to six places; with a zero vector they are 1. Filters, as of dormant entities or of a space, belong on
    ``items``: they come before the cut to k. Every task keeps k of its items for each query, so the shuffle is small.
    Up to ``broadcast_bytes`` of query vectors go to every task; beyond that, blocks of queries meet blocks of items.
    """
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where("embedding is not null")
    items = items.select(F.col("id").cast("bigint").alias("id"), "embedding").where("embedding is not null")
    size = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if size[0] * size[1] * 8 <= broadcast_bytes:
        rows = queries.toArrow()
        if not len(rows):
            return items.sparkSession.createDataFrame([], OUT + ", rank int")
        held = items.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), *_matrix(rows["embedding"])))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, waiting = Nearest(*held.value, k), []
            for batch in batches:
                waiting.append(batch)
                if sum(map(len, waiting)) >= BLOCK:
                    t = pa.Table.from_batches(waiting)
                    waiting = []
                    best.add(t["id"].to_numpy(), *_matrix(t["embedding"]))
            if waiting:
                t = pa.Table.from_batches(waiting)
                best.add(t["id"].to_numpy(), *_matrix(t["embedding"]))
            yield best.rows()

        found = spread(items, size[0] * size[1]).mapInArrow(part, OUT)
    else:
        n_q, n_i = -(-size[0] // (4 * BLOCK)), max(1, -(-items.count() // (16 * BLOCK)))
        left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
        right = items.withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(n_i)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))
        # a number of partitions that is said is not coalesced: small pairs of blocks are much work all the same
        left, right = (df.withColumn("ib", F.col("ib").cast("int")).repartition(n_q * n_i, "ib", "qb") for df in (left, right))

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            best = Nearest(a["query_id"].to_numpy(), *_matrix(a["embedding"]), k) if len(a) else Nearest(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0), k)
            if len(a) and len(b):
                best.add(b["id"].to_numpy(), *_matrix(b["embedding"]))
            return pa.Table.from_batches([best.rows()])

        found = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(block, OUT)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
