"""Label propagation in the order of the nodes over graphs that no task could hold, with the labels that a single loop gives.

A node needs the new labels of the neighbours before it and the old ones of those behind it. So a node's level is one more than the greatest level of the neighbours before
it: nodes of a level are never neighbours, and a sweep is one step for each level, in which all of its nodes take their labels at once. Edges lie in blocks in the shared
folder, each a bounded number of edges; a task holds one block and some bytes of every node: twelve where names become numbers, four where labels are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import cut

SCOPE = ["realm", "space"]
#: Ends of edges in a block.
ENTRIES = 1 << 20
#: Steps of a sweep beyond which steps do not pay.
LEVELS = 64
BLOCK = "block int, rows binary, ends binary, other binary, weight binary"
CHANGES = "rows binary, value binary"


def numbered(edges: DataFrame, parts: int) -> tuple[DataFrame, np.ndarray]:
    """(realm, space, node, key) of all ends of the edges, and their keys in order of scope and name: a node's number is its key's place."""
    end = lambda c: edges.select(*SCOPE, F.col(c).alias("node"))
    ends = end("src").unionByName(end("dst")).distinct().withColumn("name", F.col("node").cast("string"))
    ids = cut(ends.repartitionByRange(parts, *SCOPE, "name").sortWithinPartitions(*SCOPE, "name").select(*SCOPE, "node", F.xxhash64(*SCOPE, "node").alias("key")))
    got = ids.select("key", F.monotonically_increasing_id().alias("at")).toArrow()  # numbers grow with partitions, and within
    return ids, got["key"].to_numpy()[np.argsort(got["at"].to_numpy())]


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def block_of(node: np.ndarray, other: np.ndarray, turned: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, where their neighbours end, neighbours, weights): neighbours in the order in which a list of edges, sorted, first has them; parallel edges add up in it."""
    phase = np.where(turned == 1, 1, np.where(other < node, 0, 2))
    by = np.lexsort((weight, other, phase, node))
    node, other, weight = node[by], other[by], weight[by]
    pair = (node.astype(np.int64) << 32) | other.astype(np.int64)
    _, first, group = np.unique(pair, return_index=True, return_inverse=True)
    if len(first) < len(pair):
        weight = np.bincount(group, weights=weight)  # in the order of the rows
        kept = np.argsort(first)
        node, other, weight = node[first[kept]], other[first[kept]], weight[kept]
    start = _runs(node)
    return node[start], np.r_[start[1:], len(node)], other, weight


def winners(rows: np.ndarray, ends: np.ndarray, other: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The label of most weight around each row's node, the least of equals."""
    row = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
    key = row * len(label) + label[other]
    by = np.argsort(key, kind="stable")
    start = _runs(key[by])
    run = np.zeros(len(by), np.int64)
    run[start] = 1
    votes = np.bincount(np.cumsum(run) - 1, weights=weight[by])  # one after the other, as a loop adds them
    key = key[by][start]
    row = key // len(label)
    most = np.maximum.reduceat(votes, _runs(row))
    hit = np.flatnonzero(votes == most[row])
    return (key[hit] % len(label))[_runs(row[hit])]


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b, *cells in zip(*(batch.column(i) for i in range(5)), strict=True):
        rows, ends, other, weight = (np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, (np.int32, np.int64, np.int32, np.float64), strict=True))
        yield b.as_py(), rows, ends, other, weight


def _batch(ddl: str, columns: list[list]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], pa.int32() if k == "int" else pa.binary()) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def packed(edges: DataFrame, keys: np.ndarray, n_blocks: int) -> DataFrame:
    """The edges, both ways, as blocks (BLOCK) of nodes and all their neighbours."""
    by = np.argsort(keys)
    held = edges.sparkSession.sparkContext.broadcast((keys[by], by.astype(np.int32)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number = held.value
        waiting: list = []

        def out() -> pa.RecordBatch:
            a, b, w = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            node, other, weight = np.r_[b, a], np.r_[a, b], np.r_[w, w]
            turned = np.repeat(np.array([0, 1], np.int32), len(a))
            block = node % n_blocks
            order = np.argsort(block, kind="stable")
            block = block[order]
            start = _runs(block)
            cut_ = lambda x: np.split(x[order], start[1:])
            return _batch(BLOCK, [block[start].tolist(), cut_(node), cut_(turned), cut_(other), cut_(weight)])

        for batch in batches:
            a, b = (number[np.searchsorted(key, batch.column(i).to_numpy())] for i in (0, 1))
            waiting.append((a, b, batch.column(2).to_numpy()))
            if sum(len(x[0]) for x in waiting) >= ENTRIES:
                yield out()
        if waiting:
            yield out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for b, *cells in zip(*(batch.column(i) for i in range(5)), strict=True):
                got.setdefault(b.as_py(), []).append([np.frombuffer(c.as_py(), t) for c, t in zip(cells, (np.int32, np.int32, np.int32, np.float64), strict=True)])
        for b in sorted(got):
            node, turned, other, weight = (np.concatenate(x) for x in zip(*got.pop(b), strict=True))
            yield _batch(BLOCK, [[b], *([x] for x in block_of(node, other, turned, weight))])

    key = lambda c: F.xxhash64(*SCOPE, c)
    rows = edges.select(key("src").alias("a"), key("dst").alias("b"), F.col("weight").cast("double").alias("weight"))
    return cut(rows.mapInArrow(pieces, BLOCK).repartition(n_blocks, "block").mapInArrow(whole, BLOCK))


def changes(blocks: DataFrame, state: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, values) of the nodes of the blocks whose value by ``rule`` (rows, ends, other, weight, state) is not that of ``state``."""
    held = blocks.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, ends, other, weight in _arrays(batch):
                new = rule(rows, ends, other, weight, held.value)
                moved = new != held.value[rows]
                yield _batch(CHANGES, [[rows[moved]], [new[moved].astype(np.int32)]])

    got = blocks.mapInArrow(run, CHANGES).collect()
    held.destroy()
    join = lambda c: np.concatenate([np.frombuffer(r[c], np.int32) for r in got]) if got else np.zeros(0, np.int32)
    return join("rows"), join("value")


def _deeper(rows, ends, other, weight, level):
    node = np.repeat(rows, np.diff(ends, prepend=0))
    return np.maximum.reduceat(np.where(other < node, level[other] + 1, 0), np.r_[0, ends[:-1]])


def levels(blocks: DataFrame, n: int) -> np.ndarray | None:
    """The level of each node; None if there are more than LEVELS."""
    level = np.zeros(n, np.int32)
    for _ in range(LEVELS):
        at, value = changes(blocks, level, _deeper)
        if not len(at):
            return level
        level[at] = value
    return None


def by_level(blocks: DataFrame, level: np.ndarray) -> list[DataFrame]:
    """The blocks of each level by itself, so that a step reads no more than it needs."""
    held = blocks.sparkSession.sparkContext.broadcast(level.astype(np.int8))

    def only(k: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, rows, ends, other, weight in _arrays(batch):
                    size, mine = np.diff(ends, prepend=0), held.value[rows] == k
                    if mine.any():
                        of = np.repeat(mine, size)
                        yield _batch(BLOCK, [[b], [rows[mine]], [np.cumsum(size[mine])], [other[of]], [weight[of]]])

        return run

    found = []
    for k in range(int(level.max()) + 1):
        some = blocks.mapInArrow(only(k), BLOCK)
        found.append(cut(some.coalesce(max(1, min(blocks.rdd.getNumPartitions(), int((level == k).sum()) // 1024)))))
    return found


def swept(edges: DataFrame, n_edges: int, sweeps: int, entries: int = ENTRIES) -> DataFrame | None:
    """(realm, space, node, label) of all ends of the edges (realm, space, src, dst, weight), which have no loops; None where a sweep has too many steps."""
    n_blocks = max(1, -(-2 * n_edges // entries))
    ids, keys = numbered(edges, n_blocks)
    if len(keys) >= 2**31 or len(np.unique(keys)) < len(keys):
        return None
    blocks = packed(edges, keys, n_blocks)
    level = levels(blocks, len(keys))
    if level is None:
        return None
    steps = by_level(blocks, level)
    label = np.arange(len(keys), dtype=np.int32)
    for _ in range(sweeps):
        moved = 0
        for step in steps:
            at, value = changes(step, label, winners)
            label[at] = value
            moved += len(at)
        if not moved:
            break
    return named(ids, keys, label)


def named(ids: DataFrame, keys: np.ndarray, label: np.ndarray) -> DataFrame:
    """(realm, space, node, label) of the numbered ``ids``, whose labels are numbers of nodes."""
    by = np.argsort(keys)
    held = ids.sparkSession.sparkContext.broadcast((keys[by], keys[label[by]]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, of = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(of[np.searchsorted(key, batch.column(3).to_numpy())])], names=[*SCOPE, "node", "key"])

    kind = dict(ids.dtypes)["node"]
    named = ids.select("key", F.col("node").cast("string").alias("label"))
    return ids.mapInArrow(told, f"realm string, space string, node {kind}, key bigint").join(named, "key").select(*SCOPE, "node", "label")
