"""Documents into the graph, in batches, as a registered query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import bound
from graphloom.operators import indexing
from graphloom.plans import testgraph as g

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(text: str | None) -> list[str]:
    """A chunk for each line that says something."""
    return [x for x in (text or "").split("\n") if x]


def line_extractor(text: Column, known: Column) -> Column:
    """A reply in JSON, as a model would give it, for a line "subject | predicate | object"; it needs no names."""

    def reply(parts: Column) -> Column:
        part = lambda k: F.element_at(parts, k)
        entity = lambda k: F.struct(part(k).alias("name"), F.lit("Thing").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
        triple = F.struct(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))
        return F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entity(1), entity(3)).alias("entities"), F.array(triple).alias("triples"))), F.lit("\n```"))

    return bound(F.split(text, r" \| "), reply)


@query(f"""WITH e AS (SELECT event_id::BIGINT AS id, 'user ' || user_id AS a, json_extract_string(props, '$.k') AS k, event_type AS p FROM events),
first AS (SELECT id AS doc, id AS pos, a, p, 'number ' || k AS b FROM e), again AS (SELECT id AS doc, id + 1000000000 AS pos, a, p, 'number ' || k || CASE WHEN id % 3 = 0 THEN ' again' ELSE '' END AS b FROM e WHERE id % 2 = 0),
assertions AS (SELECT * FROM first WHERE NOT (doc % 2 = 0 AND doc % 3 = 0) UNION ALL SELECT * FROM again WHERE doc % 3 = 0), conflicts(p, q) AS (VALUES ('signup', 'error'), ('error', 'signup'), ('click', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'click'), ('view', 'purchase'), ('purchase', 'view')),
edges AS (SELECT a, p, b, count(*) AS weight, max(pos) AS last_pos FROM assertions GROUP BY 1, 2, 3),
closed AS (SELECT e.a, e.p, e.b, arg_min(x.p, x.pos) AS superseded_by FROM edges e JOIN conflicts c ON c.p = e.p JOIN assertions x ON x.a = e.a AND x.b = e.b AND x.p = c.q AND x.pos > e.last_pos GROUP BY 1, 2, 3)
SELECT e.a AS subject, e.p AS predicate, e.b AS object, weight::INT AS weight, superseded_by FROM edges e LEFT JOIN closed USING (a, p, b)""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a document. A second batch sends half of them once more: a third of those have changed, the others are left alone."""
    e = g.table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("id"), "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    scope = [F.lit("main").alias("realm"), F.lit("events").alias("space")]
    text = lambda more: F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" | "), "event_type", F.lit(" | number "), "k", more)
    key = F.concat(F.lit("event "), F.col("id").cast("string")).alias("doc_key")
    first = e.select(*scope, key, F.col("id").alias("pos"), text(F.lit("")).alias("text"))
    again = e.where("id % 2 = 0").select(*scope, key, (F.col("id") + 1_000_000_000).alias("pos"), text(F.when(F.col("id") % 3 == 0, " again").otherwise("")).alias("text"))
    state, _ = indexing.index_documents(first, indexing.empty(spark), line_extractor, "2024-01-01", chunker=lines)
    state, _ = indexing.index_documents(again, state, line_extractor, "2024-02-01", chunker=lines)
    names = lambda end, out: state.entities.select("realm", "space", F.col("id").alias(end), F.col("name").alias(out))
    found = state.relations(g.GROUPS).join(names("from_id", "subject"), ["realm", "space", "from_id"]).join(names("to_id", "object"), ["realm", "space", "to_id"])
    return found.select("subject", F.col("relation_type").alias("predicate"), "object", "weight", "superseded_by")
