"""Quality of a graph, of retrieval, and of judged answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.knn import least

SCOPE = ["realm", "space"]


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities at neither end of any relation. One anti-join on the union of both ends: an OR over them would compare every pair."""
    ends = relations.select(*SCOPE, F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return entities.join(ends, [*SCOPE, "id"], "left_anti")


def reach(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(realm, space, id, n_docs, n_chunks) of every entity that a chunk mentions. Two-level counts: no set of a hub's documents is held in memory."""
    pairs = mentions.select(*SCOPE, F.col("from_id").alias("chunk_id"), F.col("to_id").alias("id")).join(chunks.select(*SCOPE, F.col("id").alias("chunk_id"), "doc_key"), [*SCOPE, "chunk_id"])
    by_doc = pairs.distinct().groupBy(*SCOPE, "id", "doc_key").agg(F.count("*").alias("n"))
    return by_doc.groupBy(*SCOPE, "id").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"))


def cross_document(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities mentioned in more than one document."""
    return reach(mentions, chunks).where("n_docs > 1")


def predicate_histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type").agg(F.count("*").alias("n"))


def single_use_share(relations: DataFrame) -> DataFrame:
    """One row (predicates, single, percent): how many predicates are used once only, percent rounded down."""
    h = predicate_histogram(relations).agg(F.count("*").alias("predicates"), F.count_if(F.col("n") == 1).alias("single"))
    return h.withColumn("percent", F.when(F.col("predicates") > 0, F.floor(100 * F.col("single") / F.col("predicates"))).otherwise(0).cast("bigint"))


def type_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def likely_aliases(entities: DataFrame) -> DataFrame:
    """(token, names, n): tokens of more than three characters that several names share, most names first: names to look at for merging."""
    bare = F.transform(F.split(F.lower("name"), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,'\"()]+|[.,'\"()]+$", ""))
    token = entities.select("name", F.explode(F.array_distinct(F.filter(bare, lambda w: F.length(w) > 3))).alias("token")).distinct()
    return token.groupBy("token").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("n")).where("n > 1")


def graph_metrics(entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """(metric, value) of a graph, each table read once for its own counts."""
    e = entities.agg(F.count("*").alias("entities"), F.count_if(F.size("aliases") > 0).alias("aliased"), F.count_if(F.col("dormant_since").isNotNull()).alias("dormant"))
    known = F.col("relation_type").isin(vocabulary) if vocabulary else F.lit(True)
    r = relations.agg(F.count("*").alias("relations"), F.count_if("negated").alias("negated"), F.count_if(F.col("weight") > 1).alias("repeated"), F.count_if(F.coalesce(F.col("valid_from"), F.col("valid_to")).isNotNull()).alias("dated"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(~known).alias("outside_vocabulary"))
    p = predicate_histogram(relations).agg(F.count("*").alias("predicates"))
    one = [e, r, p, chunks.agg(F.count("*").alias("chunks")), mentions.agg(F.count("*").alias("mentions")), orphans(entities, relations).agg(F.count("*").alias("orphans")), cross_document(mentions, chunks).agg(F.count("*").alias("cross_document"))]
    long = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns])).alias("x")).select("x.*") for df in one]
    out = long[0]
    for df in long[1:]:
        out = out.unionByName(df)
    return out


def hub_relations(mentions: DataFrame, chunks: DataFrame, relations: DataFrame, k: int = 3) -> DataFrame:
    """Relations that leave the k entities mentioned in most documents, with ``n_docs``; ties by id."""
    top = reach(mentions, chunks).where("n_docs > 1").orderBy(F.desc("n_docs"), "id").limit(k)
    return relations.join(F.broadcast(top.select(*SCOPE, F.col("id").alias("from_id"), "n_docs")), [*SCOPE, "from_id"])


def as_of_sweep(relations: DataFrame, dates: list[str]) -> DataFrame:
    """(as_of, n): how many relations hold on each date; one pass, a count for each date."""
    from graphloom.functions.dates import valid_at

    counts = relations.agg(*[F.count_if(valid_at(F.col("valid_from"), F.col("valid_to"), d)).alias(f"d{i}") for i, d in enumerate(dates)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("as_of"), F.col(f"d{i}").alias("n")) for i, d in enumerate(dates)])).alias("x")).select("x.*")


def stride_sample(rows: DataFrame, n: int, order: str, by: list[str]) -> DataFrame:
    """n rows of each group at even strides of the order, all if there are no more: the rows at floor(i * step)."""
    w = Window.partitionBy(*by)
    at = (F.row_number().over(w.orderBy(order)) - 1).alias("at")
    numbered = rows.withColumn("at", at).withColumn("all_", F.count("*").over(w))
    step = F.greatest(F.col("all_") / n, F.lit(1.0))
    # a row is picked if some i has floor(i * step) = at
    i = F.ceil(F.col("at") / step)
    return numbered.where((F.floor(i * step) == F.col("at")) & (i < n)).drop("at", "all_")


def ranked_documents(chunks: DataFrame) -> DataFrame:
    """Documents in the order in which a ranking (query_id, rank, doc_key) of chunks first has them."""
    first = chunks.groupBy("query_id", "doc_key").agg(F.min("rank").alias("first"))
    return first.select("query_id", "doc_key", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_key")).alias("rank"))


def retrieval_scores(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall) at k of rankings (query_id, doc_key, rank) against gold (query_id, doc_key), for every query that has gold."""
    want = gold.select("query_id", "doc_key").distinct()
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = ranked.where(F.col("rank") <= k).join(want, ["query_id", "doc_key"], "left_semi").groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"), F.count("*").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    both = n.join(hit, "query_id", "left")
    return both.select("query_id", F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))


def missing_gold(gold: DataFrame, docs: DataFrame) -> DataFrame:
    return gold.join(docs.select("doc_key").distinct(), "doc_key", "left_anti")


def eligible(questions: DataFrame, chosen: Column | list[str], codes: str = "codes") -> DataFrame:
    """Questions all of whose evidence is among the chosen codes."""
    pick = F.array(*map(F.lit, chosen)) if isinstance(chosen, list) else chosen
    return questions.where(F.size(F.array_except(codes, pick)) == 0)


def majority(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, cast, correct): whether more than half of the votes cast (null: not cast) are true; without any it is false."""
    return votes.groupBy(*by).agg(F.count("vote").alias("cast"), (F.count_if("vote") * 2 > F.count("vote")).alias("correct"))


def agreement(votes: DataFrame, item: str = "item", judge: str = "judge") -> DataFrame:
    """(judge, agreement): how often each judge's vote is the panel's."""
    panel = majority(votes, [item])
    return votes.where("vote is not null").join(panel, item).groupBy(judge).agg(F.round(F.avg((F.col("vote") == F.col("correct")).cast("double")), 6).alias("agreement"))


def accuracy_by(results: DataFrame, kind: str = "kind", correct: str = "correct") -> DataFrame:
    """(kind, n, accuracy), with a null kind for all together."""
    return results.rollup(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the value in place n // 2, from 0, of the sorted values; by row numbers, so that no group has to fit memory."""
    w = Window.partitionBy(*by)
    numbered = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("median"), F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return numbered.where(F.col("r") == F.floor(F.col("n") / 2) + 1).drop("r", "n")


def paired_delta(results: DataFrame, baseline: str, arm: str = "arm", item: str = "item", value: str = "value") -> DataFrame:
    """(arm, better, worse, same) of each arm against the baseline, on the items that both have."""
    base = results.where(F.col(arm) == baseline).select(item, F.col(value).alias("base"))
    other = results.where(F.col(arm) != baseline).join(base, item)
    v, b = F.col(value), F.col("base")
    return other.groupBy(arm).agg(F.count_if(v > b).alias("better"), F.count_if(v < b).alias("worse"), F.count_if(v == b).alias("same"))


def swapped_verdicts(judged: DataFrame) -> DataFrame:
    """Verdicts (item, first, second) of a pair shown in both orders: A and B are the arms, and ``second`` was given with the arms swapped.

    A verdict counts only if it names the same arm both times: (winner, n), with "order" for those that followed the order and null for those without a verdict.
    """
    turned = F.when(F.col("second") == "A", "B").when(F.col("second") == "B", "A").otherwise(F.col("second"))
    winner = F.when(F.col("first").isNull() | F.col("second").isNull(), None).when(F.col("first") == turned, F.col("first")).otherwise("order")
    return judged.select(winner.alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


def mean_coverage(rows: DataFrame, by: list[str], coverage: Column) -> DataFrame:
    """The mean of a coverage that is null where there is nothing to cover."""
    return rows.groupBy(*by).agg(F.round(F.avg(coverage), 6).alias("coverage"))


def index_counters(chunks: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: what an indexing run wrote."""
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(entities.agg(F.count("*").alias("entities"))).crossJoin(relations.agg(F.count("*").alias("relations"), F.count_if("negated").alias("negated"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"))).crossJoin(mentions.agg(F.count("*").alias("mentions")))


#: Pairs of a query and a chunk that a task counts in memory.
PAIRS = 1 << 22


def chunks_mentioning(seeds: DataFrame, mentions: DataFrame, chunks: DataFrame, k: int, exclude: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Chunks that mention most of the seed entities (query_id, id): (query_id, chunk columns, hits, rank). Those of ``exclude`` (query_id, id) go after the cut to k, so fewer may remain.

    Entities meet queries with all their chunks as packed numbers, and every task counts those of its queries, so many that some PAIRS come together; a query's chunks are one task's. ``few`` seeds are sent to the mentions.
    """
    asked = seeds.select("query_id", F.col("id").alias("to_id")).distinct()
    if few:
        hit = asked.join(mentions.join(F.broadcast(asked.select("to_id").distinct()), "to_id", "left_semi"), "to_id").groupBy("query_id", *SCOPE, "from_id").agg(F.count("*").alias("hits"))
    else:
        hit = _counted(asked, mentions, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "from_id")
    top = hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("from_id", "id")
    if exclude is not None:
        top = top.join(exclude.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return top.join(chunks, [*SCOPE, "id"])


def _counted(asked: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """(query_id, realm, space, from_id, hits): of each query and space the k chunks that mention most of its entities, ties by id."""
    spark = asked.sparkSession
    degree = mentions.groupBy("to_id").agg(F.count("*").alias("n"))
    pairs = asked.groupBy("to_id").agg(F.count("*").alias("q")).join(degree, "to_id").agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    kind = dict(asked.dtypes)["query_id"]
    schema = f"realm string, space string, query_id {kind}, from_id bigint, hits bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list of chunks for each entity, or several, as it comes; ids that fit four bytes take no more."""
        waiting: list = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).sort_by([("realm", "ascending"), ("space", "ascending"), ("to_id", "ascending")]).combine_chunks()
            waiting.clear()
            ids, to = t["from_id"].to_numpy(), t["to_id"].to_numpy()
            scope = [t[c].combine_chunks().dictionary_encode() for c in SCOPE]
            scope = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).indices.to_numpy() for x in scope]
            new = np.r_[True, (to[1:] != to[:-1]) | (scope[0][1:] != scope[0][:-1]) | (scope[1][1:] != scope[1][:-1])]
            start = np.flatnonzero(new)
            small = bool(ids.min() >= 0 and ids.max() < 2**32)
            ids = ids.astype(np.uint32 if small else np.int64)
            ends = np.r_[start, len(ids)] * ids.itemsize
            cells = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            first = t.take(pa.array(start)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(first[c].combine_chunks() for c in (*SCOPE, "to_id")), cells, pa.array(np.full(len(start), small))], names=[*SCOPE, "to_id", "ids", "small"])

        for batch in batches:
            if len(batch):
                waiting.append(batch)
            if sum(map(len, waiting)) >= PAIRS:
                yield out()
        if waiting:
            yield out()

    lists = mentions.select(*SCOPE, "to_id", "from_id").repartition("to_id")
    packed = lists.mapInArrow(pack, "realm string, space string, to_id bigint, ids binary, small boolean")
    met = asked.join(packed, "to_id").select(*SCOPE, "query_id", "ids", "small").repartition(parts, "query_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: tuple | None = None
        rows, ids, n = [], [], 0

        def merged() -> tuple:
            row, id_ = np.concatenate(rows), np.concatenate(ids)
            if held is None and len(id_) and id_.min() >= 0 and id_.max() < 2**32:
                key = np.sort((row.astype(np.int64) << 32) | id_)
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                return (key[start] >> 32).astype(np.int32), key[start] & (2**32 - 1), np.diff(np.r_[start, len(key)])
            hits = np.ones(len(row), np.int64)
            if held is not None:
                row, id_, hits = np.concatenate([held[0], row]), np.concatenate([held[1], id_]), np.concatenate([held[2], hits])
            by = np.lexsort((id_, row))
            row, id_, hits = row[by], id_[by], hits[by]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (id_[1:] != id_[:-1])])
            return row[start], id_[start], np.add.reduceat(hits, start)

        for whole in batches:
            for flag in (True, False):
                batch = whole.filter(whole.column(4) if flag else pc.invert(whole.column(4)))
                if not len(batch):
                    continue
                group = [batch.column(i).dictionary_encode() for i in range(3)]
                codes, of = np.unique(np.stack([g.indices.to_numpy() for g in group]), axis=1, return_inverse=True)
                names = [g.dictionary.to_pylist() for g in group]
                number = np.array([groups.setdefault(tuple(v[c] for v, c in zip(names, code, strict=True)), len(groups)) for code in codes.T], np.int32)
                cells = batch.column(3)
                ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
                some = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32 if flag else np.int64).astype(np.int64)
                rows.append(np.repeat(number[of.ravel()], np.diff(ends) // (4 if flag else 8)))
                ids.append(some)
                n += len(some)
            if n >= 4 * PAIRS:
                held = merged()
                rows, ids, n = [], [], 0
        if n:
            held = merged()
        if held is not None:
            row, id_, hits = held
            one = hits == 1  # of these, sorted by id, a query needs no more than the first k
            before = np.cumsum(one) - one
            rank = before - before[np.searchsorted(row, row)]
            keep = ~one | (rank < k)
            row, id_, hits = least(row[keep], id_[keep], -hits[keep], k)
            realm, space, query = zip(*groups, strict=True)
            take = lambda x: pa.array(x).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([take(realm), take(space), take(query), pa.array(id_), pa.array(-hits)], names=[*SCOPE, "query_id", "from_id", "hits"])

    return met.mapInArrow(count, schema)


def edge_listing(relations: DataFrame, most: int, superseded: bool = False, dated: bool = False) -> DataFrame:
    """The first relations by id that are superseded, or dated, as asked."""
    if superseded:
        relations = relations.where("superseded_by is not null")
    if dated:
        relations = relations.where("valid_from is not null or valid_to is not null")
    return relations.orderBy("id").limit(most)


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """(realm, space, doc_key, n_chunks)."""
    return chunks.groupBy("realm", "space", "doc_key").agg(F.count("*").alias("n_chunks"))


def inbound_degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(realm, space, id, inbound) of every entity: relations that end at it, zero included."""
    n = relations.groupBy("realm", "space", F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    return entities.select("realm", "space", "id").join(n, ["realm", "space", "id"], "left").select("realm", "space", "id", F.coalesce("n", F.lit(0)).alias("inbound"))
