"""Entity resolution: mentions of a name or alias, in any case, become one entity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.sources.shared import light, stored

SCOPE = ["realm", "space"]
RESOLVED = "realm string, space string, id bigint, name string, type string, description string, aliases array<string>"
GENERIC = ("", "Concept")


def fold_names(mentions: DataFrame) -> DataFrame:
    """Mentions (realm, space, pos, id, name, type, description) folded by lower-case name.

    The longest spelling is the name, the earlier of equally long ones; the latest type that says something; the longest description, the earliest of those;
    the least id. One shuffle with partial aggregation, whatever the number of mentions of a name.
    """
    key = F.lower("name")
    said = F.when(~F.coalesce("type", F.lit("")).isin(*GENERIC), F.col("type"))
    return mentions.groupBy(*SCOPE, key.alias("key")).agg(
        F.min("id").alias("id"),
        F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"),
        F.coalesce(F.max_by("type", F.when(said.isNotNull(), F.col("pos"))), F.lit("Concept")).alias("type"),
        F.coalesce(F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos"))), F.lit("")).alias("description"),
        F.count("*").alias("n_mentions"),
    )


def resolve_components(mentions: DataFrame) -> DataFrame:
    """As ``fold_names``, but mentions that share a name or alias, however indirectly, are one entity: (…, aliases) sorted, without the name.

    Mentions that say the same are counted as one before anything else, with the first and the last place where they say it, which is all that the rules
    ask; this is done in hash tables on the mappers' side. Keys are hashed with their scope; components come from iterated joins, so no space has to fit one task.
    """
    rows = mentions.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    told = stored(rows.groupBy("name", *SCOPE, "type", "description", "aliases").agg(F.min("id").alias("id"), F.min("pos").alias("first"), F.max("pos").alias("last")))
    keys = F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda a: F.lower(a)))
    keyed = told.withColumn("node", F.xxhash64(*SCOPE, F.lower("name"))).withColumn("keys", keys)
    edges = keyed.select(F.col("node").alias("a"), F.explode(F.transform("keys", lambda k: F.xxhash64(*SCOPE, k))).alias("b"))
    parts = connected_components(edges)
    done = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    said = F.when(~F.coalesce("type", F.lit("")).isin(*GENERIC), F.col("type"))
    folded = done.groupBy("component", *SCOPE).agg(
        F.min("id").alias("id"),
        F.max_by("name", F.struct(F.length("name"), -F.col("first"))).alias("name"),
        F.coalesce(F.max_by("type", F.when(said.isNotNull(), F.col("last"))), F.lit("Concept")).alias("type"),
        F.coalesce(F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("first"))), F.lit("")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("name"), "aliases"))))).alias("all"),
    )
    return folded.withColumn("aliases", F.filter("all", lambda a: F.lower(a) != F.lower("name"))).select("realm", "space", "id", "name", "type", "description", "aliases")


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    made: list[dict] = []
    by_name: dict[str, int] = {}
    by_alias: dict[str, int] = {}

    def found(key: str) -> int | None:
        return by_name.get(key, by_alias.get(key))

    for row in pdf.sort_values("pos", kind="stable").itertuples(index=False):
        aliases = [a for a in (row.aliases if row.aliases is not None else [])]
        at = found(row.name.lower())
        for a in aliases:
            if at is None:
                at = found(a.lower())
        if at is None:
            at = len(made)
            made.append({"realm": row.realm, "space": row.space, "id": row.id, "name": row.name, "type": row.type or "Concept", "description": row.description or "", "aliases": sorted({a for a in aliases if a.lower() != row.name.lower()})})
        else:
            e = made[at]
            name = row.name if len(row.name) > len(e["name"]) else e["name"]
            e["aliases"] = sorted(a for a in {*e["aliases"], *aliases, e["name"], row.name} if a.lower() != name.lower())
            e["name"] = name
            if row.type and row.type not in GENERIC:
                e["type"] = row.type
            if len(row.description or "") > len(e["description"]):
                e["description"] = row.description
        by_name.setdefault(made[at]["name"].lower(), at)
        for a in made[at]["aliases"]:
            by_alias.setdefault(a.lower(), at)
    return pd.DataFrame(made, columns=["realm", "space", "id", "name", "type", "description", "aliases"])


def resolve_ordered(mentions: DataFrame) -> DataFrame:
    """Mentions taken one by one in order of ``pos``, each merged into the entity that its name, else an alias, then names.

    Order decides where a mention bridges two entities, so a space is one task; ``resolve_components`` is the way for spaces beyond a task's memory.
    """
    return mentions.groupBy(*SCOPE).applyInPandas(_ordered, RESOLVED)


def keys_of(entities: DataFrame) -> DataFrame:
    """(realm, space, key, entity_id): each lower-case name or alias with one entity, names before aliases, then the least id."""
    named = entities.select(*SCOPE, F.lower("name").alias("key"), F.lit(0).alias("priority"), F.col("id").alias("entity_id"))
    aliased = entities.select(*SCOPE, F.explode("aliases").alias("key"), F.lit(1).alias("priority"), F.col("id").alias("entity_id")).withColumn("key", F.lower("key"))
    return named.unionByName(aliased).where("key is not null").groupBy(*SCOPE, "key").agg(F.min(F.struct("priority", "entity_id")).alias("e")).select(*SCOPE, "key", F.col("e.entity_id").alias("entity_id"))


def lookup(names: DataFrame, entities: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with the ``entity_id`` that each names, null for none."""
    keyed = names.withColumn("key", F.lower(column))
    return keyed.join(keys_of(entities), [*SCOPE, "key"], "left").drop("key")


def linked(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with ``from_id`` and ``to_id`` in place of names; those with an end that names no entity are left out."""
    keys = keys_of(entities)
    a = keys.select(*SCOPE, F.col("key").alias("subject_key"), F.col("entity_id").alias("from_id"))
    b = keys.select(*SCOPE, F.col("key").alias("object_key"), F.col("entity_id").alias("to_id"))
    keyed = triples.withColumn("subject_key", F.lower("subject")).withColumn("object_key", F.lower("object"))
    return keyed.join(a, [*SCOPE, "subject_key"]).join(b, [*SCOPE, "object_key"]).drop("subject_key", "object_key")


def missing_ends(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities to add, of type Concept, for the ends of triples that nothing names: the first spelling of each, in order of ``pos``."""
    ends = triples.select(*SCOPE, "pos", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subject").alias("name")), F.struct(F.lit(1).alias("side"), F.col("object").alias("name")))).alias("e")).select(*SCOPE, "pos", "e.*")
    ends = ends.where("name is not null and trim(name) <> ''").withColumn("key", F.lower("name"))
    new = ends.select("key", *SCOPE).distinct().join(keys_of(entities), ["key", *SCOPE], "left_anti")
    first = ends.join(light(stored(new)), ["key", *SCOPE], "left_semi").groupBy(*SCOPE, "key").agg(F.min_by("name", F.struct("pos", "side")).alias("name"))
    return first.select(*SCOPE, "name", F.lit("Concept").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))


def merge_passes(entities: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction passes over a chunk merged: the first name, the first type that says something, the first description that does, all aliases in order;
    of equal triples the first, its validity filled in from later ones. Both have (chunk_id, pos)."""
    from graphloom.functions.text import normal_predicate

    said = F.when(~F.coalesce("type", F.lit("")).isin(*GENERIC), F.col("pos"))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.col("pos"))
    e = entities.groupBy("chunk_id", F.lower("name").alias("key")).agg(
        F.min_by("name", "pos").alias("name"), F.coalesce(F.min_by("type", said), F.lit("Concept")).alias("type"), F.coalesce(F.min_by("description", told), F.lit("")).alias("description"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")))), lambda x: x["aliases"]))).alias("aliases"),
    ).drop("key")
    t = triples.groupBy("chunk_id", F.lower("subject").alias("s"), normal_predicate(F.col("predicate")).alias("p"), F.lower("object").alias("o")).agg(
        *[F.min_by(c, "pos").alias(c) for c in ("subject", "predicate", "object", "description", "negated", "confidence")],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("valid_from", "valid_to")],
    ).drop("s", "p", "o")
    return e, t


def mention_pairs(mentions: DataFrame) -> DataFrame:
    """At most one mention of an entity by a chunk."""
    return mentions.select(*SCOPE, "from_id", "to_id").distinct()


def first_seen(names: DataFrame, most: int = 40) -> DataFrame:
    """(realm, space, names): distinct names in the order in which they were first seen, the last ``most``; context for the next batch."""
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("first"), "name")
    first = names.groupBy(*SCOPE, "name").agg(F.min("pos").alias("first")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return first.groupBy(*SCOPE).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("names"))
