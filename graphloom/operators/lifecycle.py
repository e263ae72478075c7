"""Documents come, change and go: identity, withdrawal of provenance, dormancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash

SCOPE = ["realm", "space"]


def hashes(chunks: DataFrame) -> DataFrame:
    """(realm, space, doc_key, hashes): the content hashes of each document's chunks in order of paragraph."""
    listed = F.array_sort(F.collect_list(F.struct("paragraph", content_hash(F.col("text")).alias("hash"))))
    return chunks.groupBy(*SCOPE, "doc_key").agg(F.transform(listed, lambda x: x["hash"]).alias("hashes"))


def reindex_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(realm, space, doc_key, action) of every incoming document: new, unchanged (nothing to do) or replaced."""
    before = hashes(old).withColumnRenamed("hashes", "before")
    both = hashes(new).join(before, [*SCOPE, "doc_key"], "left")
    return both.select(*SCOPE, "doc_key", F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("hashes"), "unchanged").otherwise("replaced").alias("action"))


def chunks_of(chunks: DataFrame, doc_key: str) -> DataFrame:
    """A document's chunks in order; those without a paragraph last."""
    return chunks.where(F.col("doc_key") == doc_key).orderBy(F.asc_nulls_last("paragraph"), "id")


def withdraw_sources(relations: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Relations without the chunks of ``gone`` (id) among their sources: weight is what remains, one at least; without any they go dormant.

    Sources are exploded and anti-joined on the chunk, so neither side has to be small.
    """
    left = relations.select("id", F.explode("sources").alias("source")).join(gone.select(F.col("id").alias("source")), "source", "left_anti")
    kept = left.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("kept"))
    touched = relations.select("id", F.explode("sources").alias("source")).join(gone.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct().withColumn("touched", F.lit(True))
    both = relations.join(kept, "id", "left").join(touched, "id", "left")
    sources = F.when(F.col("touched"), F.coalesce("kept", F.array().cast("array<bigint>"))).otherwise(F.col("sources"))
    both = both.withColumn("sources", sources)
    return both.withColumns({
        "weight": F.when(F.col("touched"), F.greatest(F.size("sources"), F.lit(1))).otherwise(F.col("weight")).cast("int"),
        "dormant_since": F.when(F.col("touched") & (F.size("sources") == 0), F.coalesce("dormant_since", now)).otherwise(F.col("dormant_since")),
    }).select(relations.columns)


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, mentions) of every entity, zero included."""
    n = mentions.groupBy(*SCOPE, F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    return entities.select(*SCOPE, "id").join(n, [*SCOPE, "id"], "left").select(*SCOPE, "id", F.coalesce("n", F.lit(0)).alias("mentions"))


def refresh_dormancy(entities: DataFrame, mentions: DataFrame, now: Column) -> DataFrame:
    """Entities that nothing mentions any more go dormant from ``now``; those mentioned again wake; the others stay as they are."""
    n = mention_counts(entities, mentions).select("id", "mentions")
    both = entities.join(n, "id", "left")
    return both.withColumn("dormant_since", F.when(F.col("mentions") > 0, F.lit(None)).otherwise(F.coalesce("dormant_since", now)).cast(entities.schema["dormant_since"].dataType)).select(entities.columns)


def delete_document(doc_key: str, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables without a document: its chunks and their mentions gone, provenance withdrawn, dormancy refreshed; and how many of each went."""
    gone = chunks.where(F.col("doc_key") == doc_key).select("id")
    kept = mentions.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").select(mentions.columns)
    touched = mentions.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    counts = gone.agg(F.count("*").alias("chunks")).crossJoin(touched.agg(F.count("*").alias("entities")))
    return {
        "documents": chunks.where(F.col("doc_key") != doc_key),
        "doc_mentions": kept,
        "relations": withdraw_sources(relations, gone, now),
        "entities": refresh_dormancy(entities, kept, now),
        "counts": counts,
    }
