"""Queries that score rankings and judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import anchor_coverage
from graphloom.operators import metrics
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


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's parts in order of line items, as a ranking of chunks of documents."""
    from pyspark.sql import Window

    rows = g.table(spark, sf_dir, "lineitem").join(g.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rows.select(F.col("o_custkey").cast("bigint").alias("query_id"), F.row_number().over(w).alias("rank"), (F.col("l_partkey") % 100).cast("bigint").alias("doc_key"), "l_quantity", "l_orderkey")


_RANKED = """ranked AS (SELECT o_custkey::BIGINT AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank, (l_partkey % 100)::BIGINT AS doc_key, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
docs AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_key) AS rank FROM ranked GROUP BY 1, 2)"""


@query(f"WITH {_RANKED} SELECT query_id, doc_key, rank::INT AS rank FROM docs")
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17."""
    return metrics.ranked_documents(_ranked(spark, sf_dir))


@query(f"""WITH {_RANKED}, gold AS (SELECT DISTINCT query_id, doc_key FROM ranked WHERE l_quantity >= 45), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT query_id, sum(1 / log2(rank + 1)) AS gain, count(*) AS hits FROM docs JOIN gold USING (query_id, doc_key) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg, round(coalesce(hits, 0) / n, 6) AS recall FROM n LEFT JOIN h USING (query_id)""")
def ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold are the parts ordered 45 times or more."""
    r = _ranked(spark, sf_dir)
    return metrics.retrieval_scores(metrics.ranked_documents(r), r.where("l_quantity >= 45"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderpriority)")
def accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return metrics.accuracy_by(g.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("correct")))


_VOTES = "votes AS (SELECT l_orderkey::BIGINT AS item, l_linenumber AS judge, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS vote FROM lineitem), panel AS (SELECT item, count(vote) AS cast_, coalesce(count_if(vote), 0) * 2 > count(vote) AS correct FROM votes GROUP BY 1)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("item"), F.col("l_linenumber").alias("judge"), F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("vote"))


@query(f'WITH {_VOTES} SELECT item, cast_ AS "cast", correct FROM panel')
def panel_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return metrics.majority(_votes(spark, sf_dir), ["item"])


@query(f"WITH {_VOTES} SELECT judge::INT AS judge, round(avg((vote = correct)::INT), 6) AS agreement FROM votes JOIN panel USING (item) WHERE vote IS NOT NULL GROUP BY 1")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return metrics.agreement(_votes(spark, sf_dir))


@query("SELECT event_type AS kind, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return metrics.upper_median(g.table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), ["kind"], "value")


@query("""WITH r AS (SELECT user_id::BIGINT AS item, event_type AS arm, count(*) AS value FROM events GROUP BY 1, 2), b AS (SELECT item, value AS base FROM r WHERE arm = 'view')
SELECT arm, count_if(value > base) AS better, count_if(value < base) AS worse, count_if(value = base) AS same FROM r JOIN b USING (item) WHERE arm <> 'view' GROUP BY 1""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    r = g.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("bigint").alias("item"), F.col("event_type").alias("arm")).agg(F.count("*").alias("value"))
    return metrics.paired_delta(r, "view").select("arm", *[F.col(c).cast("bigint").alias(c) for c in ("better", "worse", "same")])


@query("""WITH v AS (SELECT CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' END AS a, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' END AS b FROM events)
SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN (a = 'A' AND b = 'B') OR (a = 'B' AND b = 'A') OR (a = 'TIE' AND b = 'TIE') THEN a ELSE 'order' END AS winner, count(*) AS n FROM v GROUP BY 1""")
def swapped_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    v = lambda c: F.when(F.col(c) % 4 == 0, "A").when(F.col(c) % 4 == 1, "B").when(F.col(c) % 4 == 2, "TIE")
    return metrics.swapped_verdicts(g.table(spark, sf_dir, "events").select(F.col("event_id").alias("item"), v("user_id").alias("first"), v("event_id").alias("second")))


@query("SELECT lang, round(avg((contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT) / 2), 6) AS coverage FROM documents GROUP BY 1")
def anchor_coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28, A25."""
    return metrics.mean_coverage(g.table(spark, sf_dir, "documents"), ["lang"], anchor_coverage(F.col("text"), F.array(F.lit("the"), F.lit("DER"))))


@query("SELECT DISTINCT doc_id::BIGINT AS doc_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    key = lambda n: g.table(spark, sf_dir, n).select(F.col("doc_id").cast("bigint").alias("doc_key"))
    return metrics.missing_gold(key("documents"), key("labels")).distinct()


@query("WITH q AS (SELECT user_id::BIGINT * 1000000 + json_extract_string(props, '$.k')::BIGINT AS id, list_distinct(list(event_type)) AS codes FROM events GROUP BY 1) SELECT id FROM q WHERE len(list_filter(codes, lambda c: c NOT IN ('view', 'click', 'signup', 'purchase'))) = 0")
def eligible_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user asks of a number, if nothing failed."""
    q = g.table(spark, sf_dir, "events").groupBy((F.col("user_id").cast("bigint") * 1_000_000 + F.get_json_object("props", "$.k").cast("bigint")).alias("id")).agg(F.collect_set("event_type").alias("codes"))
    return metrics.eligible(q, ["view", "click", "signup", "purchase"]).select("id")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS n FROM documents),
i AS (SELECT lang, floor(k * greatest(n / 10, 1)) AS spot FROM (SELECT DISTINCT lang, n FROM r), range(0, 10) t(k) WHERE k < n) SELECT r.lang, doc_id::BIGINT AS doc_id FROM r JOIN i USING (lang, spot)""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator; ten of each language at even strides."""
    return metrics.stride_sample(g.table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("bigint").alias("doc_id")), 10, "doc_id", ["lang"])
