"""Queries over the graph: resolution, folding, time, walks, nearest neighbours, life cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import communities, lifecycle, metrics, relations, resolve, traverse
from graphloom.operators.knn import nearest
from graphloom.operators.scope import in_scope
from graphloom.plans import testgraph as g

QUERIES: dict = {}
SQL: dict[str, str] = {}
DATE = "1996-06-30"
INSTANT = "2024-01-03T00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a mention of its name."""
    p = g.table(spark, sf_dir, "part")
    return p.select(F.lit("main").alias("realm"), F.lit("parts").alias("space"), F.col("p_partkey").cast("bigint").alias("pos"), F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat_ws(" ", "p_brand", "p_type").alias("description"), F.array("p_brand").alias("aliases"))


@query("""SELECT min(p_partkey)::BIGINT AS id, arg_max(p_name, (length(p_name), -p_partkey)) AS name, arg_max(p_type, p_partkey) AS type,
  arg_max(concat_ws(' ', p_brand, p_type), (length(concat_ws(' ', p_brand, p_type)), -p_partkey)) AS description, count(*) AS n_mentions FROM part GROUP BY lower(p_name)""")
def entity_resolution_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 by name."""
    return resolve.fold_names(part_mentions(spark, sf_dir)).select("id", "name", "type", "description", "n_mentions")


@query("""WITH RECURSIVE m AS (SELECT p_partkey::BIGINT AS id, lower(p_name) AS a, lower(p_brand) AS b FROM part), pairs AS (SELECT DISTINCT a, b FROM m),
link AS (SELECT DISTINCT x.a AS s, y.a AS d FROM pairs x JOIN pairs y USING (b)), walk(s, d) AS (SELECT s, d FROM link UNION SELECT walk.s, link.d FROM walk JOIN link ON walk.d = link.s),
comp AS (SELECT s, min(d) AS c FROM walk GROUP BY s)
SELECT min(id)::BIGINT AS id, count(DISTINCT a)::BIGINT AS n_names FROM m JOIN comp ON m.a = comp.s GROUP BY c""")
def entity_resolution_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with aliases: names that share a brand, however indirectly, are one entity."""
    out = resolve.resolve_components(part_mentions(spark, sf_dir))
    brands = F.size(F.filter("aliases", lambda a: ~F.lower(a).like("brand%")))
    return out.select("id", (brands + F.when(F.lower("name").like("brand%"), 0).otherwise(1)).cast("bigint").alias("n_names"))


@query("SELECT min(p_partkey)::BIGINT AS id, lower(p_name) AS key, count(DISTINCT p_name)::BIGINT AS spellings FROM part GROUP BY 2")
def entity_resolution_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 one by one in order, without aliases."""
    rows = part_mentions(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    return resolve.resolve_ordered(rows).select("id", F.lower("name").alias("key"), (F.size("aliases") + 1).cast("bigint").alias("spellings"))


def part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as assertions that a supplier supplies a part, each with its order as source."""
    li = g.table(spark, sf_dir, "lineitem")
    pos = ((F.col("l_orderkey").cast("bigint") * 100 + F.col("l_linenumber")) * 100000 + F.unix_date(F.col("l_shipdate").cast("date"))).cast("bigint")
    return li.select(
        F.lit("main").alias("realm"), F.lit("star").alias("space"), (F.col("l_suppkey").cast("bigint") + g.SUPPLIER).alias("from_id"), F.lit("supplies").alias("relation_type"), (F.col("l_partkey").cast("bigint") + g.PART).alias("to_id"), pos.alias("pos"), g.day("l_shipdate").alias("t"),
        F.col("l_orderkey").cast("bigint").alias("source"), F.col("l_linestatus").alias("description"), (F.col("l_returnflag") == "R").alias("negated"), (1 - F.col("l_discount")).alias("confidence"), g.day("l_shipdate").alias("valid_from"), F.when(F.col("l_returnflag") == "A", g.day("l_shipdate")).alias("valid_to"),
    )


@query(f"""SELECT l_suppkey::BIGINT + {g.SUPPLIER} AS from_id, l_partkey::BIGINT + {g.PART} AS to_id, count(DISTINCT l_orderkey)::BIGINT AS weight, bool_and(l_returnflag = 'R') AS negated, max(1 - l_discount) AS confidence,
  arg_max(l_linestatus, (l_orderkey::BIGINT * 100 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS description, arg_max(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey::BIGINT * 100 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS valid_from,
  arg_max(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey::BIGINT * 100 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) FILTER (l_returnflag = 'A') AS valid_to, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey::BIGINT * 100 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS t_created
FROM lineitem GROUP BY 1, 2""")
def relation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, A4, A5."""
    return relations.fold(part_orders(spark, sf_dir)).select("from_id", "to_id", F.col("weight").cast("bigint").alias("weight"), "negated", "confidence", "description", "valid_from", "valid_to", "t_created")


@query(f"WITH {g.SQL_NODES}, {g.SQL_RELATIONS} SELECT r.id, a.name AS src_id, r.relation_type, b.name AS tgt_id, r.weight::BIGINT AS weight FROM relations r JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, P15, S9."""
    return relations.with_ends(g.relations(spark, sf_dir), g.nodes(spark, sf_dir)).select("id", "src_id", "relation_type", "tgt_id", F.col("weight").cast("bigint").alias("weight"))


@query(f"""WITH {g.SQL_MENTIONS} SELECT x.id, coalesce(n, 0)::BIGINT AS mentions FROM (SELECT p_partkey::BIGINT + {g.PART} AS id FROM part UNION ALL SELECT c_custkey::BIGINT + {g.CUSTOMER} FROM customer) x
LEFT JOIN (SELECT to_id, count(*) AS n FROM mentions GROUP BY 1) m ON m.to_id = x.id""")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3."""
    e = g.nodes(spark, sf_dir).where(F.col("type").isin("Part", "Customer"))
    return lifecycle.mention_counts(e, g.mentions(spark, sf_dir)).select("id", "mentions")


@query(f"""WITH {g.SQL_NODES}, {g.SQL_MENTIONS} SELECT id, (CASE WHEN id IN (SELECT to_id FROM mentions) THEN false ELSE true END) AS dormant FROM nodes""")
def dormant_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: what nothing mentions goes dormant, what is mentioned wakes."""
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    return lifecycle.refresh_dormancy(g.nodes(spark, sf_dir), g.mentions(spark, sf_dir), now).select("id", F.col("dormant_since").isNotNull().alias("dormant"))


def seeds(spark: SparkSession, sf_dir: str, kind: str, start: int) -> DataFrame:
    """Every one of a kind is a question of its own."""
    key = {"supplier": "s_suppkey", "nation": "n_nationkey", "customer": "c_custkey"}[kind]
    t = g.table(spark, sf_dir, kind)
    return t.select(F.col(key).cast("bigint").alias("query_id"), (F.col(key).cast("bigint") + start).alias("seed"))


@query(f"""WITH {g.SQL_MENTIONS}, hit AS (SELECT s_suppkey::BIGINT AS query_id, m.from_id, count(*) AS hits FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey::BIGINT + {g.PART} AS part FROM lineitem) l ON l_suppkey = s_suppkey JOIN mentions m ON m.to_id = l.part GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, from_id) AS rank FROM hit) SELECT query_id, from_id AS id, hits::BIGINT AS hits, rank::BIGINT AS rank FROM top WHERE rank <= 10""")
def mention_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the ten orders that mention most of its parts."""
    s = g.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("query_id"), (F.col("l_partkey").cast("bigint") + g.PART).alias("id")).distinct()
    return metrics.chunks_mentioning(s, g.mentions(spark, sf_dir), g.chunks(spark, sf_dir), 10).select("query_id", "id", "hits", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {g.SQL_NODES}, {g.SQL_SUPPLIES} SELECT s_suppkey::BIGINT AS query_id, r.id, r.to_id, n.name FROM supplier JOIN supplies r ON r.from_id = s_suppkey + {g.SUPPLIER} JOIN nodes n ON n.id = r.to_id")
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    f = seeds(spark, sf_dir, "supplier", g.SUPPLIER).withColumnRenamed("seed", "node")
    e = g.nodes(spark, sf_dir)
    hit = traverse.neighbours(f, g.supplies(spark, sf_dir), e)
    return hit.join(e.select(F.col("id").alias("to_id"), "name"), "to_id").select("query_id", "id", "to_id", "name")


def _walk(filters: str, cap: str) -> str:
    return f"""WITH RECURSIVE {g.SQL_RELATIONS}, edges AS (SELECT * FROM relations WHERE {filters}), start AS (SELECT c_custkey::BIGINT AS query_id, c_custkey::BIGINT + {g.CUSTOMER} AS seed FROM customer),
walk(query_id, node, d) AS (SELECT query_id, seed, 0 FROM start UNION SELECT query_id, to_id, d + 1 FROM walk JOIN edges ON from_id = node WHERE d < 2),
dist AS (SELECT query_id, node, min(d) AS d FROM walk GROUP BY 1, 2),
out AS (SELECT query_id, e.id, d + 1 AS hops, row_number() OVER (PARTITION BY query_id ORDER BY d, e.id) AS r FROM dist JOIN edges e ON e.from_id = node WHERE d < 2)
SELECT query_id, id, hops::INT AS hops FROM out WHERE {cap}"""


@query(_walk("relation_type <> 'supplies'", "true"))
def neighborhood_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from every customer."""
    r = g.places(spark, sf_dir).unionByName(g.ordered(spark, sf_dir))
    return traverse.neighbourhood(seeds(spark, sf_dir, "customer", g.CUSTOMER), r, hops=2, most=None).select("query_id", "id", "hops")


@query(_walk("relation_type <> 'supplies'", "r <= 20"))
def khop_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty closest."""
    r = g.places(spark, sf_dir).unionByName(g.ordered(spark, sf_dir))
    return traverse.neighbourhood(seeds(spark, sf_dir, "customer", g.CUSTOMER), r, hops=2, most=20).select("query_id", "id", "hops")


@query(_walk("relation_type IN ('located_in', 'part_of')", "true"))
def khop_type_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only along places."""
    return traverse.neighbourhood(seeds(spark, sf_dir, "customer", g.CUSTOMER), g.relations(spark, sf_dir), hops=2, most=None, types=["located_in", "part_of"]).select("query_id", "id", "hops")


@query(f"WITH {g.SQL_RELATIONS} SELECT id FROM relations WHERE (valid_from IS NULL OR valid_from <= '{DATE}') AND (valid_to IS NULL OR valid_to >= '{DATE}')")
def as_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated relations always hold."""
    return relations.visible(g.relations(spark, sf_dir), as_of=DATE).select("id")


_CLOSED = f"""WITH {g.SQL_ASSERTIONS}, edges AS (SELECT from_id, relation_type, to_id, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(t, pos) AS t_created FROM assertions GROUP BY 1, 2, 3),
closed AS (SELECT e.from_id, e.relation_type, e.to_id, min(a.pos) AS at FROM edges e JOIN conflicts c ON c.p = e.relation_type JOIN assertions a ON a.from_id = e.from_id AND a.to_id = e.to_id AND a.relation_type = c.q AND a.pos > e.last_pos GROUP BY 1, 2, 3),
history AS (SELECT e.*, a.relation_type AS superseded_by, a.t AS t_expired FROM edges e LEFT JOIN closed USING (from_id, relation_type, to_id) LEFT JOIN assertions a ON a.pos = closed.at)
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.assertions(spark, sf_dir)
    created = rows.groupBy(*relations.EDGE).agg(F.min_by("t", "pos").alias("t_created"))
    return relations.supersede(rows, g.GROUPS).join(created, relations.EDGE)


@query(_CLOSED + "SELECT from_id, relation_type, to_id, first_pos, last_pos, superseded_by, t_expired FROM history")
def supersession_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, W12, M8."""
    return _history(spark, sf_dir).select("from_id", "relation_type", "to_id", "first_pos", "last_pos", "superseded_by", "t_expired")


@query(_CLOSED + "SELECT from_id, relation_type, to_id FROM history WHERE superseded_by IS NULL")
def supersession_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    return relations.visible(_history(spark, sf_dir)).select("from_id", "relation_type", "to_id")


@query(_CLOSED + f"SELECT from_id, relation_type, to_id FROM history WHERE t_created <= '{INSTANT}' AND (t_expired IS NULL OR t_expired > '{INSTANT}')")
def as_believed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph held at an instant."""
    return relations.visible(_history(spark, sf_dir), include_superseded=True, as_believed_at=INSTANT).select("from_id", "relation_type", "to_id")


@query()
def supersession_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rules, replayed in order."""
    return relations.supersede_strict(g.assertions(spark, sf_dir), g.GROUPS).select("from_id", "relation_type", "to_id", "superseded_by", "t_expired")


@query(f"WITH {g.SQL_RELATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY id DESC) AS rank FROM relations) SELECT from_id, id, rank::INT AS rank FROM r WHERE rank <= 8")
def contradiction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, L4."""
    return relations.contradiction_candidates(g.relations(spark, sf_dir), 8).select("from_id", "id", "rank")


def _knn_sql(where: str, k: int) -> str:
    return f"""WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
d AS (SELECT q.id AS query_id, i.id, round(1 - list_sum(list_transform(list_zip(q.e, i.e), lambda p: p[1] * p[2])) / (q.l * i.l), 6) + 0.0 AS distance FROM n q JOIN n i ON {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, distance, rank::INT AS rank FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "embedding", "label")


@query(_knn_sql("true", 5))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a question."""
    v = _vectors(spark, sf_dir)
    return nearest(v.select(F.col("id").alias("query_id"), "embedding"), v, 5)


@query(_knn_sql("i.label <> 0", 5))
def knn_dormant_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of label 0 are dormant; the filter comes before the cut, so five remain."""
    v = _vectors(spark, sf_dir)
    return nearest(v.select(F.col("id").alias("query_id"), "embedding"), v.where("label <> 0"), 5)


@query(_knn_sql("i.label = 3", 3))
def knn_space_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as spaces."""
    v = _vectors(spark, sf_dir)
    items = in_scope(v.withColumn("space", F.col("label").cast("string")), space="3")
    return nearest(v.select(F.col("id").alias("query_id"), "embedding"), items, 3)


@query(f"WITH {g.SQL_NODES}, {g.SQL_RELATIONS} SELECT id, name FROM nodes WHERE id NOT IN (SELECT from_id FROM relations WHERE relation_type IN ('supplies', 'ordered') UNION SELECT to_id FROM relations WHERE relation_type IN ('supplies', 'ordered'))")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that no trade touches, among all."""
    return metrics.orphans(g.nodes(spark, sf_dir), g.relations(spark, sf_dir).where(F.col("relation_type").isin("supplies", "ordered"))).select("id", "name")


@query(f"WITH {g.SQL_MENTIONS}, {g.SQL_CHUNKS} SELECT to_id AS id, count(DISTINCT doc_key)::BIGINT AS n_docs, count(DISTINCT from_id)::BIGINT AS n_chunks FROM mentions JOIN chunks ON chunks.id = from_id GROUP BY 1 HAVING count(DISTINCT doc_key) > 1")
def cross_document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, A12."""
    return metrics.cross_document(g.mentions(spark, sf_dir), g.chunks(spark, sf_dir)).select("id", "n_docs", "n_chunks")


@query(f"""WITH {g.SQL_MENTIONS}, {g.SQL_CHUNKS}, {g.SQL_RELATIONS}, top AS (SELECT to_id AS id, count(DISTINCT doc_key) AS n_docs FROM mentions JOIN chunks ON chunks.id = from_id GROUP BY 1 HAVING count(DISTINCT doc_key) > 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT r.id, r.relation_type, r.from_id AS to_id, n_docs::BIGINT AS n_docs FROM relations r JOIN top ON r.to_id = top.id""")
def hub_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations are turned round, since the entities of most documents are things ordered."""
    r = g.relations(spark, sf_dir)
    turned = r.select(*[F.col({"from_id": "to_id", "to_id": "from_id"}.get(c, c)).alias(c) for c in r.columns])
    return metrics.hub_relations(g.mentions(spark, sf_dir), g.chunks(spark, sf_dir), turned).select("id", "relation_type", "to_id", "n_docs")


@query(f"WITH {g.SQL_RELATIONS} SELECT relation_type, count(*) AS n FROM relations GROUP BY 1")
def predicate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return metrics.predicate_histogram(g.relations(spark, sf_dir))


@query(f"WITH {g.SQL_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return metrics.type_histogram(g.nodes(spark, sf_dir))


@query(f"""WITH {g.SQL_NODES}, {g.SQL_RELATIONS}, {g.SQL_MENTIONS}, {g.SQL_CHUNKS}
SELECT 'entities' AS metric, count(*)::BIGINT AS value FROM nodes UNION ALL SELECT 'aliased', 0 UNION ALL SELECT 'dormant', count(*) FROM nodes WHERE dormant
UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'negated', 0 UNION ALL SELECT 'repeated', count(*) FROM relations WHERE weight > 1 UNION ALL SELECT 'dated', count(*) FROM relations WHERE valid_from IS NOT NULL
UNION ALL SELECT 'superseded', 0 UNION ALL SELECT 'outside_vocabulary', count(*) FROM relations WHERE relation_type NOT IN ('supplies', 'ordered') UNION ALL SELECT 'predicates', count(DISTINCT relation_type) FROM relations
UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'orphans', count(*) FROM nodes WHERE id NOT IN (SELECT from_id FROM relations UNION SELECT to_id FROM relations)
UNION ALL SELECT 'cross_document', count(*) FROM (SELECT to_id FROM mentions JOIN chunks ON chunks.id = from_id GROUP BY 1 HAVING count(DISTINCT doc_key) > 1)""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A16, P20."""
    return metrics.graph_metrics(g.nodes(spark, sf_dir), g.relations(spark, sf_dir), g.mentions(spark, sf_dir), g.chunks(spark, sf_dir), ["supplies", "ordered"])


@query(f"WITH {g.SQL_RELATIONS} SELECT d.as_of, count(*) AS n FROM relations JOIN (VALUES ('1993'), ('1995-06'), ('{DATE}')) d(as_of) ON (valid_from IS NULL OR valid_from <= rpad(d.as_of, 10, '-01')) AND (valid_to IS NULL OR valid_to >= rpad(d.as_of, 10, '-01')) GROUP BY 1")
def as_of_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    return metrics.as_of_sweep(g.relations(spark, sf_dir), ["1993", "1995-06", DATE])


@query(f"WITH {g.SQL_RELATIONS} SELECT id, relation_type, valid_from, valid_to FROM relations WHERE valid_from IS NOT NULL OR valid_to IS NOT NULL ORDER BY id LIMIT 12")
def dated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first twelve."""
    return metrics.edge_listing(g.relations(spark, sf_dir), 12, dated=True).select("id", "relation_type", "valid_from", "valid_to")


@query(f"WITH {g.SQL_NODES} SELECT token, count(*) AS n FROM (SELECT DISTINCT name, unnest(list_distinct(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: length(w) > 3))) AS token FROM nodes) GROUP BY 1 HAVING count(*) > 1")
def likely_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return metrics.likely_aliases(g.nodes(spark, sf_dir)).select("token", "n")


@query(f"""WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT l_suppkey::BIGINT + {g.SUPPLIER} AS from_id, l_partkey::BIGINT + {g.PART} AS to_id, l_orderkey FROM lineitem)
SELECT from_id, to_id, greatest(count(DISTINCT CASE WHEN k IS NULL THEN l_orderkey END), 1)::INT AS weight, count(DISTINCT CASE WHEN k IS NULL THEN l_orderkey END) = 0 AS dormant FROM s LEFT JOIN gone ON k = l_orderkey GROUP BY 1, 2""")
def withdraw_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the orders that are done no longer vouch for anything."""
    r = relations.fold(part_orders(spark, sf_dir)).withColumns({"id": F.xxhash64("from_id", "to_id"), "dormant_since": F.lit(None).cast("timestamp_ntz")})
    gone = g.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("bigint").alias("id"))
    out = lifecycle.withdraw_sources(r, gone, F.lit("2025-01-01").cast("timestamp_ntz"))
    return out.select("from_id", "to_id", "weight", F.col("dormant_since").isNotNull().alias("dormant"))


_PARTITION = f"""part_ AS (SELECT c_custkey::BIGINT + {g.CUSTOMER} AS node, c_nationkey::BIGINT AS community FROM customer UNION ALL SELECT s_suppkey::BIGINT + {g.SUPPLIER}, s_nationkey::BIGINT FROM supplier UNION ALL SELECT n_nationkey::BIGINT + {g.NATION}, n_nationkey::BIGINT FROM nation)"""


def _assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities of their customers and suppliers."""
    t = lambda n: g.table(spark, sf_dir, n)
    one = lambda df, key, nation, kind: df.select(F.lit("main").alias("realm"), F.lit("star").alias("space"), (F.col(key).cast("bigint") + kind).alias("node"), F.col(nation).cast("bigint").alias("community"))
    return one(t("customer"), "c_custkey", "c_nationkey", g.CUSTOMER).unionByName(one(t("supplier"), "s_suppkey", "s_nationkey", g.SUPPLIER)).unionByName(one(t("nation"), "n_nationkey", "n_nationkey", g.NATION))


@query(f"WITH {_PARTITION} SELECT community, count(*) AS size FROM part_ GROUP BY 1 HAVING count(*) >= 2")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, P18."""
    return communities.grouped(_assignment(spark, sf_dir)).select("community", "size")


@query(f"WITH {_PARTITION}, {g.SQL_RELATIONS} SELECT r.id, a.community FROM relations r JOIN part_ a ON a.node = from_id JOIN part_ b ON b.node = to_id WHERE a.community = b.community")
def intra_community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    return communities.inner_relations(g.relations(spark, sf_dir), _assignment(spark, sf_dir)).select("id", "community")


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS community_id, count(*) AS size, round(avg(c_acctbal) / 1000, 3) AS rating, (n_nationkey % 7) / 10.0 AS distance FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
c AS (SELECT community_id, distance, round(1.0 * (1 - distance) + 0.25 * least(greatest(rating, 0), 10) / 10 + 0.15 * (ln(1 + size) / (SELECT ln(1 + max(size)) FROM s)), 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, distance, community_id) AS rank FROM c) SELECT community_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def community_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11."""
    n = g.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("community_id")).agg(F.count("*").alias("size"), F.round(F.avg("c_acctbal") / 1000, 3).alias("rating"))
    hits = n.withColumns({"query_id": F.lit(0).cast("bigint"), "distance": (F.col("community_id") % 7) / 10.0})
    return communities.rank_communities(hits, 5).select("community_id", "score", "rank")


@query("""WITH t AS (SELECT c_custkey::BIGINT AS pos, c_mktsegment AS base, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT pos, CASE WHEN n = 1 THEN base ELSE base || ' (' || c_name || ')' END AS title FROM t""")
def title_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    c = g.table(spark, sf_dir, "customer").select(F.lit("main").alias("realm"), F.lit("star").alias("space"), F.col("c_custkey").cast("bigint").alias("pos"), F.col("c_mktsegment").alias("title"), F.array("c_mktsegment", "c_name").alias("names"))
    return communities.unique_titles(c).select("pos", "title")


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole graph."""
    e = g.nodes(spark, sf_dir)
    return communities.label_propagation(e, communities.cluster_edges(g.relations(spark, sf_dir), e)).select("node", "community")


@query("SELECT c.c_custkey::BIGINT AS pos, n_nationkey::BIGINT + 2000000000000 AS entity_id FROM customer c JOIN nation ON n_nationkey = c_nationkey")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in another case find their entity, and so do aliases, which every other customer uses."""
    c = g.table(spark, sf_dir, "customer").join(g.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.lit("main").alias("realm"), F.lit("star").alias("space"), F.col("c_custkey").cast("bigint").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("STATE-"), F.col("n_nationkey").cast("string"))).otherwise(F.lower("n_name")).alias("name"))
    states = g.nodes(spark, sf_dir).where("type = 'Nation'").withColumn("aliases", F.array(F.concat(F.lit("State-"), (F.col("id") - g.NATION).cast("string"))))
    return resolve.lookup(names, states).select("pos", "entity_id")


@query("SELECT DISTINCT event_type AS name FROM events")
def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of triples that nothing names become stubs."""
    t = g.table(spark, sf_dir, "events").select(F.lit("main").alias("realm"), F.lit("star").alias("space"), F.col("event_id").alias("pos"), F.lit("ASIA").alias("subject"), F.col("event_type").alias("object"))
    return resolve.missing_ends(t, g.nodes(spark, sf_dir)).select("name")


@query("SELECT 'c' || o_custkey AS doc_key, count(*) AS n_chunks FROM orders GROUP BY 1")
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return metrics.chunks_per_document(g.chunks(spark, sf_dir)).select("doc_key", "n_chunks")


@query(f"WITH {g.SQL_NODES}, {g.SQL_RELATIONS}, n AS (SELECT to_id AS id, count(*) AS n FROM relations GROUP BY 1) SELECT id, coalesce(n, 0) AS inbound FROM nodes LEFT JOIN n USING (id)")
def inbound_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    return metrics.inbound_degree(g.nodes(spark, sf_dir), g.relations(spark, sf_dir)).select("id", "inbound")


@query()
def leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole graph by modularity."""
    e = g.nodes(spark, sf_dir)
    return communities.leiden_communities(e, communities.cluster_edges(g.relations(spark, sf_dir), e)).select("node", "community")
