"""A property graph over the star schema, as DataFrames and as the same views in SQL.

Nodes are regions, nations, customers, suppliers and parts; relations are where they lie and what they supply and order; chunks are orders, which mention their
customer and parts; events are assertions about users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are kind * KIND + key.
KIND = 1_000_000_000_000
EDGE = 1_000_000_000_000_000_000
GROUPS = [["signup", "error"], ["click", "view", "purchase"]]
REGION, NATION, CUSTOMER, SUPPLIER, PART = (k * KIND for k in range(1, 6))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scope() -> list:
    return [F.lit("main").alias("realm"), F.lit("star").alias("space")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(realm, space, id, name, type, description, aliases, dormant_since): customers in debt are dormant."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("timestamp_ntz")

    def part(df: DataFrame, kind: int, key: str, name: str, kind_name: str, told, dormant=none) -> DataFrame:
        return df.select(*_scope(), (F.col(key).cast("bigint") + kind).alias("id"), F.col(name).alias("name"), F.lit(kind_name).alias("type"), told.alias("description"), F.array().cast("array<string>").alias("aliases"), dormant.alias("dormant_since"))

    out = part(t("region"), REGION, "r_regionkey", "r_name", "Region", F.lit(""))
    out = out.unionByName(part(t("nation"), NATION, "n_nationkey", "n_name", "Nation", F.lit("")))
    out = out.unionByName(part(t("customer"), CUSTOMER, "c_custkey", "c_name", "Customer", F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, F.lit("2000-01-01").cast("timestamp_ntz"))))
    out = out.unionByName(part(t("supplier"), SUPPLIER, "s_suppkey", "s_name", "Supplier", F.lit("")))
    return out.unionByName(part(t("part"), PART, "p_partkey", "p_name", "Part", F.concat_ws(" ", "p_brand", "p_type")))


def _edge(df: DataFrame, number: int, a, b, kind: str, weight=None, start=None, end=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        *_scope(), (F.lit(number).cast("bigint") * EDGE + (a % KIND) * 1_000_000_000 + b % KIND).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("relation_type"), F.lit("").alias("description"),
        (F.lit(1) if weight is None else weight).cast("int").alias("weight"), F.lit(False).alias("negated"), F.lit(1.0).alias("confidence"), (none if start is None else start).alias("valid_from"), (none if end is None else end).alias("valid_to"),
        none.alias("t_created"), none.alias("t_expired"), F.lit(None).cast("bigint").alias("superseded_by"), (none if end is None else end).alias("asserted_at"),
    )


def _key(c: str, kind: int):
    return F.col(c).cast("bigint") + kind


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of and located_in relations."""
    t = lambda n: table(spark, sf_dir, n)
    out = _edge(t("nation"), 1, _key("n_nationkey", NATION), _key("n_regionkey", REGION), "part_of")
    out = out.unionByName(_edge(t("customer"), 2, _key("c_custkey", CUSTOMER), _key("c_nationkey", NATION), "located_in"))
    return out.unionByName(_edge(t("supplier"), 3, _key("s_suppkey", SUPPLIER), _key("s_nationkey", NATION), "located_in"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier supplies a part: weight is the number of orders, validity from the first shipment to the last."""
    # one shuffle by the edge: both levels of the distinct count then stay where they are
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_shipdate").repartition("l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("w"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return _edge(li, 4, _key("l_suppkey", SUPPLIER), _key("l_partkey", PART), "supplies", F.col("w"), day("a"), day("b"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer ordered a part."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    both = rows.repartition("o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("w"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return _edge(both, 5, _key("o_custkey", CUSTOMER), _key("l_partkey", PART), "ordered", F.col("w"), day("a"), day("b"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).unionByName(supplies(spark, sf_dir)).unionByName(ordered(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks; a customer's orders are one document."""
    o = table(spark, sf_dir, "orders")
    return o.select(*_scope(), F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderpriority").alias("text"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_key"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mention their customer and their parts, each once."""
    o = table(spark, sf_dir, "orders").select(*_scope(), F.col("o_orderkey").cast("bigint").alias("from_id"), _key("o_custkey", CUSTOMER).alias("to_id"))
    p = table(spark, sf_dir, "lineitem").select(*_scope(), F.col("l_orderkey").cast("bigint").alias("from_id"), _key("l_partkey", PART).alias("to_id")).distinct()
    return o.unionByName(p)


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a user and the number in its properties, the event's type as predicate, in order of event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(*_scope(), F.col("user_id").cast("bigint").alias("from_id"), F.col("event_type").alias("relation_type"), F.get_json_object("props", "$.k").cast("bigint").alias("to_id"), F.col("event_id").cast("bigint").alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))


SQL_NODES = f"""nodes AS (
  SELECT r_regionkey::BIGINT + {REGION} AS id, r_name AS name, 'Region' AS type, '' AS description, false AS dormant FROM region
  UNION ALL SELECT n_nationkey::BIGINT + {NATION}, n_name, 'Nation', '', false FROM nation
  UNION ALL SELECT c_custkey::BIGINT + {CUSTOMER}, c_name, 'Customer', c_mktsegment, c_acctbal < 0 FROM customer
  UNION ALL SELECT s_suppkey::BIGINT + {SUPPLIER}, s_name, 'Supplier', '', false FROM supplier
  UNION ALL SELECT p_partkey::BIGINT + {PART}, p_name, 'Part', concat_ws(' ', p_brand, p_type), false FROM part
)"""
_ID = "::BIGINT * 1000000000000000000 + (from_id % 1000000000000) * 1000000000 + to_id % 1000000000000"
SQL_PLACES = f"""places AS (
  SELECT (n{_ID})::BIGINT AS id, from_id, to_id, relation_type, 1 AS weight, CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM (
    SELECT 1 AS n, n_nationkey::BIGINT + {NATION} AS from_id, n_regionkey::BIGINT + {REGION} AS to_id, 'part_of' AS relation_type FROM nation
    UNION ALL SELECT 2, c_custkey::BIGINT + {CUSTOMER}, c_nationkey::BIGINT + {NATION}, 'located_in' FROM customer
    UNION ALL SELECT 3, s_suppkey::BIGINT + {SUPPLIER}, s_nationkey::BIGINT + {NATION}, 'located_in' FROM supplier)
)"""
SQL_SUPPLIES = f"""supplies AS (
  SELECT (4{_ID})::BIGINT AS id, from_id, to_id, 'supplies' AS relation_type, w AS weight, a AS valid_from, b AS valid_to FROM (
    SELECT l_suppkey::BIGINT + {SUPPLIER} AS from_id, l_partkey::BIGINT + {PART} AS to_id, count(DISTINCT l_orderkey)::INT AS w, strftime(min(l_shipdate), '%Y-%m-%d') AS a, strftime(max(l_shipdate), '%Y-%m-%d') AS b FROM lineitem GROUP BY 1, 2)
)"""
SQL_ORDERED = f"""ordered AS (
  SELECT (5{_ID})::BIGINT AS id, from_id, to_id, 'ordered' AS relation_type, w AS weight, a AS valid_from, b AS valid_to FROM (
    SELECT o_custkey::BIGINT + {CUSTOMER} AS from_id, l_partkey::BIGINT + {PART} AS to_id, count(DISTINCT l_orderkey)::INT AS w, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
)"""
SQL_RELATIONS = f"{SQL_PLACES}, {SQL_SUPPLIES}, {SQL_ORDERED}, relations AS (SELECT * FROM places UNION ALL SELECT * FROM supplies UNION ALL SELECT * FROM ordered)"
SQL_MENTIONS = f"""mentions AS (
  SELECT o_orderkey::BIGINT AS from_id, o_custkey::BIGINT + {CUSTOMER} AS to_id FROM orders
  UNION ALL SELECT DISTINCT l_orderkey::BIGINT, l_partkey::BIGINT + {PART} FROM lineitem
)"""
SQL_CHUNKS = "chunks AS (SELECT o_orderkey::BIGINT AS id, o_orderpriority AS text, 'c' || o_custkey::VARCHAR AS doc_key FROM orders)"
SQL_ASSERTIONS = """assertions AS (
  SELECT user_id::BIGINT AS from_id, event_type AS relation_type, json_extract_string(props, '$.k')::BIGINT AS to_id, event_id::BIGINT AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events
), conflicts(p, q) AS (VALUES ('signup', 'error'), ('error', 'signup'), ('click', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'click'), ('view', 'purchase'), ('purchase', 'view'))"""
