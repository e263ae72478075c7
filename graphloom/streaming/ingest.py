"""Incremental ingest: assertions arrive as a stream; batches are merged as they come, or supersession is kept as state by pair of entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.relations import EDGE, fold, supersede
from graphloom.sources.files import Store


def merge_batches(stream: DataFrame, store: Store, checkpoint: str, groups: list[list[str]], log: str = "assertions", out: str = "relations") -> StreamingQuery:
    """Adds each micro-batch of assertions to a log in the store, folds the log's touched pairs anew and writes the relations as a new version.

    A batch is a directory named by its number; one that was merged before, as after a restart, changes nothing. Only edges between pairs of entities that the
    batch names are folded again: the others are taken over as they are, by an anti-join.
    """
    by = ["realm", "space", "from_id", "to_id"]

    def merge(batch: DataFrame, number: int) -> None:
        # the batch is added beside the others; folding its pairs again, as after a restart, gives the same relations
        store.append(log, batch, number)
        rows = store.log(log)
        touched = batch.select(*by).distinct()
        mine = rows.join(touched, by, "left_semi").drop("batch")
        closed = supersede(mine, groups).select(*EDGE, "superseded_by", "t_expired")
        new = fold(mine).join(closed, EDGE)
        if store.versions(out):
            new = store.read(out).join(touched, by, "left_anti").unionByName(new)
        store.write(out, new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CLOSED = "realm string, space string, from_id bigint, to_id bigint, relation_type string, superseded_by string, t_expired string"


class Superseding(StatefulProcessor):
    """For a pair of entities, which predicates are open; an assertion closes those that exclude it, and opens its own again."""

    def __init__(self, table: dict[str, list[str]]) -> None:
        self.table = table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "relation_type string", "pos bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("pos", kind="stable").itertuples(index=False):
            rivals = self.table.get(row.relation_type.lower(), [])
            for (name,), _ in list(self.open.iterator()):
                if name.lower() in rivals:
                    self.open.removeKey((name,))
                    out.append((*key, name, row.relation_type, row.t))
            self.open.updateValue((row.relation_type,), (int(row.pos),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass


def superseding_stream(stream: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Closings as they happen, from a stream of assertions (realm, space, from_id, relation_type, to_id, pos, t). Order within a batch is that of ``pos``, between batches that of arrival.

    State is one entry for each open predicate of a pair, kept by key in the state store; it needs the RocksDB provider.
    """
    table: dict[str, set[str]] = {}
    for g in groups:
        low = {p.lower() for p in g}
        for p in low:
            table.setdefault(p, set()).update(low - {p})
    return stream.groupBy("realm", "space", "from_id", "to_id").transformWithStateInPandas(Superseding({k: sorted(v) for k, v in table.items()}), CLOSED, "Append", "None")


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Assertions (ts, relation_type) counted by window of event time; later than the watermark, they are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "relation_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "relation_type", "n")
