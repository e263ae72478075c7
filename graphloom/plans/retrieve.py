"""Retrieval as one lazy plan for a batch of questions: every step is keyed by ``query_id``; a single question is a batch of one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import fallback_keywords, question_text
from graphloom.functions.vectors import embedded
from graphloom.operators import communities as comm
from graphloom.operators import fuse
from graphloom.operators.knn import nearest
from graphloom.operators.lexical import search
from graphloom.operators.metrics import chunks_mentioning
from graphloom.operators.relations import triple_rows, visible, with_ends
from graphloom.operators.scope import in_scope
from graphloom.operators.traverse import closest, neighbourhood, node_distances
from graphloom.sources.shared import cut, light

MODES = ("naive", "local", "global", "hybrid", "mix", "bypass")
ENTITIES = ("local", "hybrid", "mix")
CHUNKS = ("naive", "local", "hybrid", "mix")
THEMES = ("global", "hybrid")
#: Questions up to which what was found for them is sent to the tables.
MANY = 500


@dataclass(frozen=True)
class Ask:
    """How to retrieve and what of it to keep."""

    mode: str = "mix"
    realm: str | None = None
    space: str | None = None
    k: int = 5
    hops: int = 1
    as_of: str | None = None
    as_believed_at: str | None = None
    include_superseded: bool = False
    exclude_dormant: bool = True
    most_edges: int = 200
    lexical_k: int = 50
    lexical: bool = True
    embed_relations: bool = True
    expand_mentions: bool = True
    merge: str = "rrf"
    quota: float = 0.5
    distance_rerank: bool = False
    mmr: float | None = None
    community_factor: int = 3
    community_weights: tuple[float, float, float] = comm.WEIGHTS
    total_tokens: int = 6000
    entity_tokens: int = 1500
    relation_tokens: int = 1500
    style: str = "several paragraphs"

    def __post_init__(self) -> None:
        if self.mode.lower() not in MODES:
            raise ValueError(f"no mode {self.mode!r}; there are {', '.join(MODES)}")
        if self.merge not in ("rrf", "quota"):
            raise ValueError(f"merge is rrf or quota, not {self.merge!r}")


@dataclass(frozen=True)
class Graph:
    """The tables that retrieval reads; those that are not there are None."""

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame | None = None
    mentions: DataFrame | None = None
    communities: DataFrame | None = None
    embedder: object = None
    keywords: Callable[[Column], Column] = field(default=fallback_keywords)


@dataclass(frozen=True)
class Found:
    """What each question (query_id) got, in order of ``rank`` or ``pos``."""

    entities: DataFrame
    triples: DataFrame
    chunks: DataFrame
    communities: DataFrame


ENTITY_ROW = "query_id bigint, id bigint, name string, type string, description string, distance double, rank int"
CHUNK_ROW = "query_id bigint, id bigint, text string, document string, distance double, rank int"
THEME_ROW = "query_id bigint, community_id bigint, title string, summary string, rating double, size bigint, distance double, score double, rank int"


def _vectors(questions: DataFrame, graph: Graph, text: Column) -> DataFrame:
    if "embedding" in questions.columns:
        return questions.select("query_id", "embedding")
    return questions.select("query_id", embedded(graph.embedder, text).alias("embedding"))


def retrieve(questions: DataFrame, graph: Graph, ask: Ask = Ask()) -> Found:
    """Questions (query_id, text), embedded by the graph's embedder unless they have an ``embedding``.

    Visible relations are filtered before the walk, so nothing is reached through what a question may not see. The channels are the walk from the nearest
    entities, relations near the question and relations that share its words; each is filtered and ordered by itself, then all are merged and reranked.
    """
    spark, mode = questions.sparkSession, ask.mode.lower()
    none = lambda ddl: spark.createDataFrame([], ddl)
    scoped = lambda df: in_scope(df, ask.realm, ask.space)
    entities, relations = scoped(graph.entities), visible(scoped(graph.relations), ask.include_superseded, ask.as_of, ask.as_believed_at)
    few = questions.limit(MANY + 1).count() <= MANY
    bare = relations.drop("embedding")

    def ends_of(hits: DataFrame) -> DataFrame:
        """Names are joined to hits, never to all relations; a few hits are sent to the relations, and then to the names."""
        if not few:
            return with_ends(hits.join(bare, "id"), entities)
        return with_ends(cut(light(cut(hits)).join(bare, "id")), entities, few=True)

    def related() -> DataFrame:
        """The relations nearest to each question, searched once."""
        if not seen:
            seen.append(cut(nearest(asked, relations, ask.most_edges)).select("query_id", "id", F.col("rank").cast("bigint").alias("pos")))
        return seen[0]

    texts = relations.select("id", F.concat_ws(" ", F.replace(F.col("relation_type"), F.lit("_"), F.lit(" ")), "description").alias("text"))
    found_e, found_c, found_t = none(ENTITY_ROW), none(CHUNK_ROW), none(THEME_ROW)
    channels: list[DataFrame] = []
    seen: list[DataFrame] = []
    start = distances = None
    asked = _vectors(questions, graph, F.col("text")) if mode != "bypass" else None

    if mode in ENTITIES:
        vectors = asked if "embedding" in questions.columns else _vectors(questions, graph, question_text(F.col("text"), graph.keywords(F.col("text"))))
        live = entities.where("dormant_since is null") if ask.exclude_dormant else entities
        # k rows a question, read by every later step: written once, so that no step searches again
        near = cut(nearest(vectors, live, ask.k))
        found_e = light(near).join(entities.select("id", "name", "type", "description"), "id").select("query_id", "id", "name", "type", "description", "distance", "rank")
        start = near.select("query_id", F.col("id").alias("seed"))
        walked = cut(neighbourhood(start, bare, ask.hops, ask.most_edges, few=few))
        distances = node_distances(start, walked)
        rows = triple_rows(with_ends(closest(walked), entities, few and walked.limit(MANY * ask.most_edges + 1).count() <= MANY * ask.most_edges).withColumn("pos", F.col("id")), F.col("hops"))
        channels.append(fuse.hop_recency(fuse.dedupe(rows)).withColumn("channel", F.lit(0)))
        if ask.embed_relations and "embedding" in relations.columns and (ask.merge == "rrf" or ask.quota > 0):
            channels.append(triple_rows(ends_of(related())).withColumn("channel", F.lit(1)))
        if ask.lexical and ask.merge == "rrf" and "text" in questions.columns:
            hit = search(questions, texts, ask.lexical_k).select("query_id", "id", F.col("rank").cast("bigint").alias("pos"))
            channels.append(triple_rows(ends_of(hit)).withColumn("channel", F.lit(2)))

    if mode in CHUNKS and graph.chunks is not None:
        chunks = scoped(graph.chunks)
        named = chunks.select("realm", "space", "id", "text", F.coalesce("doc_key", F.concat(F.lit("Doc Chunk "), F.col("id").cast("string"))).alias("document"))
        near = cut(nearest(asked, chunks, ask.k))
        found_c = light(near).join(named, "id").select("query_id", "id", "text", "document", "distance", "rank")
        if ask.expand_mentions and start is not None and graph.mentions is not None:
            more = chunks_mentioning(start.withColumnRenamed("seed", "id"), scoped(graph.mentions), named, ask.k, near, few)
            found_c = found_c.unionByName(more.select("query_id", "id", "text", "document", F.lit(1.0).alias("distance"), (F.col("rank") + ask.k).alias("rank")))

    if mode in THEMES:
        if graph.communities is not None:
            themes = scoped(graph.communities)
            hits = nearest(asked, themes, ask.k * max(1, ask.community_factor)).withColumnRenamed("id", "community_id").drop("rank")
            told = themes.select(F.col("id").alias("community_id"), "title", "summary", "rating", F.col("size").cast("bigint").alias("size"))
            found_t = comm.rank_communities(hits.join(told, "community_id"), ask.k, ask.community_weights).select("query_id", "community_id", "title", "summary", "rating", "size", "distance", "score", "rank")
        if "embedding" in relations.columns:
            near = triple_rows(ends_of(related()))
        else:
            # relations that share a term with the question, or whose ends' names do: two joins on terms, and no product of questions and relations
            words = questions.select("query_id", graph.keywords(F.col("text")).alias("words"))
            named = search(questions, entities.select("id", F.col("name").alias("text")), ask.most_edges).select("query_id", F.col("id").alias("end"))
            by_name = relations.select("id", F.explode(F.array("from_id", "to_id")).alias("end")).join(named, "end").select("query_id", "id")
            hit = search(questions, texts, ask.most_edges).select("query_id", "id").unionByName(by_name).distinct().withColumn("pos", F.col("id"))
            near = fuse.keyword_rank(triple_rows(ends_of(hit)).join(words, "query_id"), F.col("words"), ask.most_edges).drop("words", "hits")
        walk = channels[0].drop("channel") if channels else None
        both = near if walk is None else walk.unionByName(near.withColumn("pos", F.col("pos") + 2**40))
        channels[:1] = [fuse.hop_recency(fuse.dedupe(both)).withColumn("channel", F.lit(0))]

    if not channels:
        triples = spark.createDataFrame([], "query_id bigint, pos bigint, src_id string, tgt_id string, edge_id bigint, src_key bigint, tgt_key bigint, relation_type string, description string, weight int, negated boolean, confidence double, valid_from string, valid_to string, t_created string, t_expired string, superseded_by bigint, asserted_at string, hops int")
        return Found(found_e, triples, found_c, found_t)
    if ask.merge == "rrf":
        merged = channels[0]
        for c in channels[1:]:
            merged = merged.unionByName(c)
        triples = fuse.reciprocal_rank(merged).drop("channel")
    else:
        first = channels[0].drop("channel")
        second = channels[1].drop("channel") if len(channels) > 1 else first.where("false")
        triples = fuse.dedupe(fuse.quota_interleave(first, second, ask.quota))
    if ask.distance_rerank and distances is not None:
        triples = fuse.nearest_first(triples, distances)
    if ask.mmr is not None:
        triples = fuse.diversify(triples, ask.mmr)
    return Found(found_e, triples, found_c, found_t)


def _joined(items: DataFrame, budget: int, name: str) -> DataFrame:
    kept = fuse.token_budget(items, budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(name))


def contexts(questions: DataFrame, found: Found, ask: Ask = Ask()) -> DataFrame:
    """(query_id, themes, passages, entities, relations, prompt): what a model reads of each question, under the budgets; "None" for what is empty."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = found.entities.select("query_id", F.col("rank").alias("pos"), F.concat(F.lit("- Entity "), "name", F.lit(" ("), F.coalesce("type", F.lit("Concept")), F.lit("): "), said("description")).alias("line"))
    no = F.when(F.coalesce("negated", F.lit(False)), "NOT ").otherwise("")
    t = found.triples.select("query_id", "pos", F.concat(F.lit("- ("), "src_id", F.lit(") --["), no, "relation_type", F.lit(" (weight="), F.col("weight").cast("string"), F.lit(")]--> ("), "tgt_id", F.lit("): "), said("description")).alias("line"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    c = found.chunks.select("query_id", n.alias("pos"), "document", "text").withColumn("line", F.concat(F.lit("Chunk ["), F.col("pos").cast("string"), F.lit("] ("), "document", F.lit("): "), said("text")))
    m = found.communities.select("query_id", F.col("rank").alias("pos"), F.concat(F.lit("- "), said("title"), F.lit(" (importance "), said("rating").cast("string"), F.lit(", "), F.col("size").cast("string"), F.lit(" entities): "), said("summary")).alias("line"))
    refs = c.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "document"))), lambda x: F.concat(F.lit("- ["), x["pos"].cast("string"), F.lit("] "), x["document"])), "\n").alias("sources"))
    out = questions.select("query_id", "text")
    for part in (_joined(m, ask.total_tokens // 3, "themes"), _joined(c, ask.total_tokens // 2, "passages"), _joined(e, ask.entity_tokens, "entities"), _joined(t, ask.relation_tokens, "relations"), refs):
        out = out.join(part, "query_id", "left")
    for name in ("themes", "passages", "entities", "relations", "sources"):
        out = out.withColumn(name, F.coalesce(F.nullif(name, F.lit("")), F.lit("None")))
    prompt = F.concat_ws(
        "\n\n", F.lit(f"Answer from what was found in the knowledge graph ({ask.mode.lower()} retrieval), in the form of {ask.style}. Where it does not hold the answer, say so; cite passages by their numbers, as [1]."),
        F.concat(F.lit("Themes:\n"), "themes"), F.concat(F.lit("Passages:\n"), "passages"), F.concat(F.lit("Entities:\n"), "entities"), F.concat(F.lit("Relations:\n"), "relations"), F.concat(F.lit("Sources:\n"), "sources"), F.concat(F.lit("Question: "), "text"),
    )
    return out.withColumn("prompt", F.when(F.lit(ask.mode.lower() == "bypass"), F.col("text")).otherwise(prompt))


def answers(questions: DataFrame, found: Found, complete: Callable[[Column], Column], ask: Ask = Ask()) -> DataFrame:
    """(query_id, question, answer) by a provider: a function from a prompt column to its completions."""
    return contexts(questions, found, ask).select("query_id", F.col("text").alias("question"), complete(F.col("prompt")).alias("answer"))
