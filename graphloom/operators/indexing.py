"""Documents into the graph: chunk, compare, extract, resolve, fold, supersede, mention; batch after batch.

The state is four tables: chunks, entities, assertions (each triple that a chunk states, in order) and mentions. Relations follow from the assertions. A document that comes
again as it was is left alone; one that has changed takes back all that its old chunks said.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.chunking import chunked, pack_paragraphs
from graphloom.functions.text import content_hash
from graphloom.operators.extract import Rules, entity_rows, parse_extraction, triple_rows
from graphloom.operators.lifecycle import refresh_dormancy
from graphloom.operators.relations import EDGE, SORTED, fold, supersede
from graphloom.operators.resolve import first_seen, keys_of, mention_pairs, missing_ends, resolve_components
from graphloom.sources.shared import light, stored

SCOPE = ["realm", "space"]
CHUNKS = "realm string, space string, id bigint, doc_key string, paragraph int, text string, content_hash string, pos bigint"
ENTITIES = "realm string, space string, id bigint, name string, type string, description string, aliases array<string>, dormant_since string"
ASSERTIONS = "realm string, space string, from_id bigint, relation_type string, to_id bigint, pos decimal(38,0), t string, source bigint, description string, negated boolean, confidence double, valid_from string, valid_to string"
MENTIONS = "realm string, space string, from_id bigint, to_id bigint"
#: Assertions of one chunk, and chunks of one document, that positions leave room for; positions are decimals, so documents may be as many as there are.
ROOM = 1_000_000
ORDER = "decimal(38,0)"
#: Spaces whose known names, some kilobytes each, are sent to every task.
FEW_SPACES = 10_000


@dataclass(frozen=True)
class State:
    """The tables of a graph; ``relations`` are folded from the assertions, with what superseded them."""

    chunks: DataFrame
    entities: DataFrame
    assertions: DataFrame
    mentions: DataFrame

    def relations(self, groups: list[list[str]]) -> DataFrame:
        closed = supersede(self.assertions, groups).select(*EDGE, "superseded_by", "t_expired")
        folded = fold(self.assertions)
        return folded.join(closed, SORTED).select(*folded.columns, "superseded_by", "t_expired")


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], s) for s in (CHUNKS, ENTITIES, ASSERTIONS, MENTIONS)))


def _id(*parts: str | Column) -> Column:
    """An id that does not depend on partitions or batches: what has the same name has the same id."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _identified(rows: DataFrame, odd: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the id of the entity that ``column`` names, which there must be.

    Most ids follow from the name, so that rows need meet only the ``odd`` (realm, space, key, entity_id): aliases, and names of entities that had their ids from another name.
    """
    found = odd.select(*SCOPE, F.col("key").alias("its_key"), F.col("entity_id").alias("its_id"))
    keyed = rows.withColumn("its_key", F.lower(column)).join(found, ["its_key", *SCOPE], "left")
    return keyed.withColumn(out, F.coalesce("its_id", _id(*SCOPE, "its_key"))).drop("its_key", "its_id")


def extractions(chunks: DataFrame, extractor: Callable[[Column, Column], Column], known: DataFrame | None = None, gleanings: int = 0) -> DataFrame:
    """(…, extraction) of every chunk. ``extractor`` makes a reply of a text and the names known before the batch; replies that are not JSON give nothing.

    With ``gleanings`` it is asked again so many times, each time knowing what was found in the chunk so far; the passes' finds are put end to end.
    """
    rows = chunks.join(known, SCOPE, "left") if known is not None else chunks.withColumn("names", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.withColumn("extraction", parse_extraction(extractor(F.col("text"), F.col("names"))))
    for _ in range(gleanings):
        found = F.array_distinct(F.concat("names", F.coalesce(F.transform("extraction.entities", lambda e: e["name"]), F.array().cast("array<string>"))))
        more = parse_extraction(extractor(F.col("text"), found))
        both = lambda part: F.concat(F.coalesce(f"extraction.{part}", F.array()), F.coalesce(F.col(f"more.{part}"), F.array())).alias(part)  # noqa: E731, B023
        rows = rows.withColumn("more", more).withColumn("extraction", F.struct(both("entities"), both("triples"))).drop("more")
    return rows.drop("names")


def index_documents(
    docs: DataFrame, state: State, extractor: Callable[[Column, Column], Column], t: str, rules: Rules = Rules(), chunker: Callable[[str], list[str]] = pack_paragraphs, context: int = 40, gleanings: int = 0,
) -> tuple[State, DataFrame]:
    """The state after a batch of documents (realm, space, doc_key, pos, text), and (realm, space, doc_key, action) of each document: new, unchanged or replaced.

    ``pos`` orders documents over all batches; ``t`` is the time of the batch. Names that the graph knows already, the last ``context`` of each space, go to the extractor. Ends of triples that nothing
    names become entities of type Concept. An entity keeps its id when it is found again, under any of its names. Null and empty texts have no chunks; of a
    document that repeats in a batch the one of the greatest pos counts. Every table is written once, so that the next batch reads and does not recompute it.
    """
    last = docs.groupBy("doc_key", *SCOPE).agg(F.max_by(F.struct("pos", "text"), "pos").alias("d")).select(*SCOPE, "doc_key", F.col("d.pos").cast("bigint").alias("pos"), chunked(F.col("d.text"), chunker).alias("texts"))
    before = state.chunks.groupBy("doc_key", *SCOPE).agg(F.array_sort(F.collect_list(F.struct("paragraph", "content_hash")))["content_hash"].alias("before"))
    action = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.transform("texts", content_hash), "unchanged").otherwise("replaced")
    batch = stored(last.join(before, ["doc_key", *SCOPE], "left").select(*SCOPE, "doc_key", "pos", "texts", action.alias("action"))).where("size(texts) > 0")
    plan = batch.select(*SCOPE, "doc_key", "action")
    todo = batch.where("action <> 'unchanged' and realm is not null and space is not null and doc_key is not null")
    gone = stored(state.chunks.join(todo.where("action = 'replaced'"), ["doc_key", *SCOPE], "left_semi").select("id", *SCOPE))
    fresh = todo.select(*SCOPE, "doc_key", "pos", F.posexplode("texts").alias("paragraph", "text")).withColumns({"paragraph": F.col("paragraph") + 1, "content_hash": content_hash(F.col("text"))})
    fresh = fresh.withColumn("id", _id(*SCOPE, "doc_key", "paragraph", "content_hash")).select(*_columns(CHUNKS))

    seen = state.mentions.join(state.chunks.select(F.col("id").alias("from_id"), *SCOPE, "pos"), ["from_id", *SCOPE]).groupBy(F.col("to_id").alias("id"), *SCOPE).agg(F.min("pos").alias("pos"))
    known = light(stored(first_seen(seen.join(state.entities.select("id", *SCOPE, "name"), ["id", *SCOPE]), context)), FEW_SPACES)
    found = stored(extractions(fresh, extractor, known, gleanings).select(*SCOPE, F.col("id").alias("source"), (F.col("pos").cast("decimal(19,0)") * ROOM + F.col("paragraph")).alias("at"), "extraction"))
    place = (F.col("at") * ROOM + F.col("item")).cast(ORDER).alias("pos")
    stated = stored(entity_rows(found, rules).select(*SCOPE, "source", place, "name", "type", "description", "aliases"))
    triples = stored(triple_rows(found, rules).select(*SCOPE, "source", place, "subject", "predicate", "object", "description", "negated", "confidence", "valid_from", "valid_to"))

    none = F.lit(None).cast("bigint")
    old = state.entities.select(*SCOPE, F.lit(-1).cast(ORDER).alias("pos"), "id", "name", "type", "description", "aliases")
    merged = stored(resolve_components(old.unionByName(stated.select(*SCOPE, "pos", none.alias("id"), "name", "type", "description", "aliases"))))
    more = missing_ends(triples, merged.withColumn("id", F.lit(0).cast("bigint"))).withColumn("id", none)
    entities = merged.unionByName(more, allowMissingColumns=True).withColumn("id", F.coalesce("id", _id(*SCOPE, F.lower("name"))))
    entities = stored(entities.join(state.entities.select("id", "dormant_since"), "id", "left"))

    odd = light(stored(keys_of(entities).where(F.col("entity_id") != _id(*SCOPE, "key"))))
    said = _identified(_identified(triples, odd, "subject", "from_id"), odd, "object", "to_id").withColumnRenamed("predicate", "relation_type").withColumn("t", F.lit(t))
    assertions = stored(state.assertions.join(gone.withColumnRenamed("id", "source"), ["source", *SCOPE], "left_anti").select(*_columns(ASSERTIONS)).unionByName(said.select(*_columns(ASSERTIONS))))
    by_name = _identified(stated.select(*SCOPE, F.col("source").alias("from_id"), "name"), odd, "name", "to_id").drop("name")
    ends = said.select(*SCOPE, F.col("source").alias("from_id"), F.explode(F.array("from_id", "to_id")).alias("to_id"))
    kept = state.mentions.join(gone.withColumnRenamed("id", "from_id"), ["from_id", *SCOPE], "left_anti")
    mentions = stored(kept.select(*_columns(MENTIONS)).unionByName(mention_pairs(by_name.unionByName(ends))))
    chunks = state.chunks.join(gone, ["id", *SCOPE], "left_anti").select(*_columns(CHUNKS)).unionByName(fresh)
    return State(stored(chunks), stored(refresh_dormancy(entities, mentions, F.lit(t))), assertions, mentions), plan
