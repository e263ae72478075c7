"""Relations: folding assertions, exclusive predicates, supersession, and what a query may see."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.dates import known_at, valid_at

SCOPE = ["realm", "space"]
EDGE = [*SCOPE, "from_id", "relation_type", "to_id"]
#: The pair, and the edge, in the order in which they are sorted fastest: realm and space are the same in most rows, so they come last.
PAIR = ["from_id", "to_id", *SCOPE]
SORTED = ["from_id", "to_id", "relation_type", *SCOPE]


def weight_of(sources: Column) -> Column:
    """How many distinct chunks assert a relation, one at least."""
    return F.greatest(F.size(F.array_distinct(sources)), F.lit(1))


def fold(assertions: DataFrame) -> DataFrame:
    """Assertions (EDGE, pos, t, source, description, negated, confidence, valid_from, valid_to) folded to one relation for each edge.

    Sources are united and counted, assertions without one count each; the last description and validity that say something; negated only if all are;
    the greatest confidence; created with the first.
    """
    said = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos")))
    folded = assertions.groupBy(*SORTED).agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count_if(F.col("source").isNull()).alias("unsourced"),
        said("description").alias("description"),
        F.bool_and("negated").alias("negated"),
        F.max("confidence").alias("confidence"),
        said("valid_from").alias("valid_from"),
        said("valid_to").alias("valid_to"),
        F.min_by("t", "pos").alias("t_created"),
        F.max("pos").alias("last_pos"),
        F.max_by("t", "pos").alias("asserted_at"),
    )
    weight = F.greatest(F.size("sources") + F.col("unsourced"), F.lit(1)).cast("int").alias("weight")
    return folded.select(*EDGE, *[c for c in folded.columns if c not in (*EDGE, "unsourced")], weight)


def conflicts(spark, groups: list[list[str]]) -> DataFrame:
    """(p, q) of different predicates that exclude each other, lower case: two that share a group."""
    pairs = sorted({(a.lower(), b.lower()) for g in groups for a in g for b in g if a.lower() != b.lower()})
    return spark.createDataFrame(pairs, "p string, q string")


def supersede(assertions: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Edges with what closed them: (EDGE, first_pos, last_pos, superseded_by, t_expired).

    Assertions are (EDGE, pos, t). An edge is closed by the first later assertion of an excluding predicate between the same two entities that
    comes after the edge's last assertion: asserting it again opens it again, and the first to close it stays.
    ``superseded_by`` is that predicate. The pairs come from configuration and are broadcast; the self-join shuffles on the two entities.
    """
    spark = assertions.sparkSession
    edges = assertions.groupBy(*SORTED).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    later = assertions.select(*PAIR, F.col("relation_type").alias("closer"), F.col("pos").alias("at"), "t")
    pairs = conflicts(spark, groups)
    hit = edges.join(F.broadcast(pairs), F.lower("relation_type") == F.col("p")).join(later, PAIR)
    hit = hit.where((F.lower("closer") == F.col("q")) & (F.col("at") > F.col("last_pos")))
    closed = hit.groupBy(*SORTED).agg(F.min(F.struct("at", "closer", "t")).alias("c"))
    return edges.join(closed, SORTED, "left").select(*EDGE, "first_pos", "last_pos", F.col("c.closer").alias("superseded_by"), F.col("c.t").alias("t_expired"))


def supersede_strict(assertions: DataFrame, groups: list[list[str]]) -> DataFrame:
    """The literal rule, in order of arrival and for comparison only: every assertion closes all excluding edges, also those closed before, and asserting again opens nothing."""
    table: dict[str, set[str]] = {}
    for g in groups:
        low = {p.lower() for p in g}
        for p in low:
            table.setdefault(p, set()).update(low - {p})

    names = [*EDGE, "first_pos", "last_pos", "superseded_by", "t_expired"]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, edges, out = None, {}, []

        def close() -> None:
            out.extend((*pair[:3], kind, pair[3], *e) for kind, e in edges.items())
            edges.clear()

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at = (row.realm, row.space, row.from_id, row.to_id)
                if at != pair:
                    if pair:
                        close()
                    pair = at
                edges.setdefault(row.relation_type, [row.pos, row.pos, None, None])[1] = row.pos
                for other, e in edges.items():
                    if other.lower() in table.get(row.relation_type.lower(), ()) and e[2] != row.relation_type:
                        e[2], e[3] = row.relation_type, row.t
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if pair:
            close()
            yield pd.DataFrame(out, columns=names)

    by = [*SCOPE, "from_id", "to_id"]
    rows = assertions.select(*EDGE, "pos", "t").repartition(*by).sortWithinPartitions(*by, "pos")
    return rows.mapInPandas(replay, "realm string, space string, from_id bigint, relation_type string, to_id bigint, first_pos bigint, last_pos bigint, superseded_by string, t_expired string")


def mark_superseded(relations: DataFrame, closed: DataFrame) -> DataFrame:
    """Relations with those of ``closed`` (id, superseded_by, t_expired) closed; those closed before keep what closed them."""
    marks = closed.groupBy("id").agg(F.min(F.struct(F.col("t_expired").alias("t"), F.col("superseded_by").alias("by"))).alias("mark"))
    open_ = F.col("superseded_by").isNull() & F.col("mark").isNotNull()
    return relations.join(marks, "id", "left").withColumns({"t_expired": F.when(open_, F.col("mark.t")).otherwise(F.col("t_expired")), "superseded_by": F.when(open_, F.col("mark.by")).otherwise(F.col("superseded_by"))}).select(relations.columns)


def contradiction_candidates(relations: DataFrame, most: int = 10) -> DataFrame:
    """For each subject its newest relations that are open, numbered: what a judge compares a new one with."""
    w = Window.partitionBy(*SCOPE, "from_id").orderBy(F.desc("id"))
    return relations.where("superseded_by is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def contradicted(candidates: DataFrame, judge) -> DataFrame:
    """Candidates that the judge, a function of a DataFrame to ids (id), finds contradicted; ids that were not offered count for nothing."""
    return candidates.join(judge(candidates).select("id").distinct(), "id", "left_semi")


def visible(triples: DataFrame, include_superseded: bool = False, as_of: str | None = None, as_believed_at: str | None = None) -> DataFrame:
    """Triples that a query may see: open ones unless told otherwise, holding on a date, believed at an instant.

    Belief alone does not bring back what was superseded later: that takes ``include_superseded`` as well.
    """
    if not include_superseded:
        triples = triples.where("superseded_by is null")
    if as_of:
        triples = triples.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of))
    if as_believed_at:
        triples = triples.where(known_at(F.col("t_created"), F.col("t_expired"), as_believed_at))
    return triples


def with_ends(relations: DataFrame, entities: DataFrame, few: bool = False) -> DataFrame:
    """Relations as triple rows, with both names; those with an end that is gone are left out.

    Names are joined by id, so that Catalyst chooses between broadcasting a small space and two shuffles; ``few`` relations, which the caller has counted, go to the names instead.
    """
    ends = entities.select(*SCOPE, "id", "name")
    a = ends.select(*SCOPE, F.col("id").alias("from_id"), F.col("name").alias("src_id"))
    b = ends.select(*SCOPE, F.col("id").alias("to_id"), F.col("name").alias("tgt_id"))
    if few:
        return F.broadcast(F.broadcast(relations).join(a, [*SCOPE, "from_id"])).join(b, [*SCOPE, "to_id"])
    return relations.join(a, [*SCOPE, "from_id"]).join(b, [*SCOPE, "to_id"])


def triple_rows(relations: DataFrame, hops: Column | int = 1) -> DataFrame:
    """The common row of all channels, from relations with ends; ``query_id`` and ``pos`` pass by where they are."""
    more = [c for c in ("query_id", "pos", "realm", "space", "distance", "score") if c in relations.columns]
    fill = lambda c, t: F.col(c).cast(t) if c in relations.columns else F.lit(None).cast(t)
    return relations.select(
        *more, "src_id", "tgt_id", F.col("id").alias("edge_id"), F.col("from_id").alias("src_key"), F.col("to_id").alias("tgt_key"), "relation_type",
        F.coalesce(fill("description", "string"), F.lit("")).alias("description"), F.coalesce(fill("weight", "int"), F.lit(1)).alias("weight"), F.coalesce(fill("negated", "boolean"), F.lit(False)).alias("negated"),
        F.coalesce(fill("confidence", "double"), F.lit(1.0)).alias("confidence"), *[fill(c, "string").alias(c) for c in ("valid_from", "valid_to", "t_created", "t_expired")],
        fill("superseded_by", "bigint").alias("superseded_by"), fill("asserted_at", "string").alias("asserted_at"), (F.lit(hops) if isinstance(hops, int) else hops).cast("int").alias("hops"),
    )
