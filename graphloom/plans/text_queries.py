"""Queries over texts: chunks, identity, names, dates, pages, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import chunking, dates, text
from graphloom.operators import extract, lexical, lifecycle
from graphloom.plans import testgraph as g
from graphloom.sources.files import render_sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(r"""WITH RECURSIVE lines AS (
  SELECT doc_id::BIGINT AS doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 40 AND NOT starts_with(p, '==')) AS ls FROM documents
), step(doc_id, ls, k, buf, done) AS (
  SELECT doc_id, ls, 2, ls[1], CAST(NULL AS VARCHAR) FROM lines WHERE len(ls) > 0
  UNION ALL
  SELECT doc_id, ls, k + 1, CASE WHEN k > len(ls) THEN NULL WHEN full_ THEN regexp_replace(rest || chr(10) || ls[k], '^\s+|\s+$', '', 'g') ELSE buf || chr(10) || ls[k] END, CASE WHEN k > len(ls) OR full_ THEN buf END FROM (
    SELECT *, length(buf) + length(ls[k]) + 1 > 2000 AS full_, CASE WHEN strpos(right(buf, 200), '. ') BETWEEN 1 AND length(right(buf, 200)) - 2 THEN substr(right(buf, 200), strpos(right(buf, 200), '. ') + 2) ELSE right(buf, 200) END AS rest
    FROM step WHERE buf IS NOT NULL) x
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS paragraph, substr(sha256(done), 1, 32) AS content_hash FROM step WHERE done IS NOT NULL""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, W14, F7."""
    rows = chunking.numbered_chunks(g.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id::BIGINT AS doc_id, substr(sha256(text), 1, 32) AS content_hash, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F9."""
    return g.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.content_hash(F.col("text")).alias("content_hash"), text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT source AS doc_key, CASE WHEN bool_and(lang = 'en') THEN 'unchanged' WHEN bool_or(lang = 'en') THEN 'replaced' ELSE 'new' END AS action FROM documents GROUP BY 1""")
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English part was indexed before, now all comes."""
    d = g.table(spark, sf_dir, "documents")
    rows = d.select(F.lit("main").alias("realm"), F.lit("docs").alias("space"), text.document_key(F.col("source"), F.lit("x")).alias("doc_key"), F.col("doc_id").alias("paragraph"), "text", "lang")
    return lifecycle.reindex_plan(rows.where("lang = 'en'"), rows).select("doc_key", "action")


@query(r"""WITH p AS (SELECT p_partkey::BIGINT AS id, CASE p_partkey % 6 WHEN 0 THEN 'Was ' WHEN 1 THEN ' is--' WHEN 2 THEN 'have_' WHEN 3 THEN 'Does a ' ELSE '' END || p_name AS raw FROM part),
n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[\s\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS x FROM p)
SELECT id, CASE WHEN regexp_matches(x, '^(was|is|have|does)_...') THEN regexp_replace(x, '^(was|is|have|does)_', '') ELSE x END AS predicate FROM n""")
def predicate_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    k = F.col("p_partkey") % 6
    lead = F.when(k == 0, "Was ").when(k == 1, " is--").when(k == 2, "have_").when(k == 3, "Does a ").otherwise("")
    return g.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), text.normal_predicate(F.concat(lead, "p_name")).alias("predicate"))


@query("""SELECT event_id::BIGINT AS id, CASE event_type WHEN 'signup' THEN 'joined' WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'click_on' ELSE event_type END AS predicate FROM events""")
def predicate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """renamed, or taken to the vocabulary's entry that begins alike."""
    e = g.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("bigint").alias("id"), text.canonical_predicate(F.col("event_type"), {"signup": "joined"}, ["joined", "viewed", "click_on"]).alias("predicate"))


@query("""WITH d AS (SELECT o_orderkey::BIGINT AS id, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN year(o_orderdate) || '-' || month(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'unknown' ELSE 'in ' || year(o_orderdate) END AS raw, o_orderdate AS d FROM orders)
SELECT id, CASE id % 5 WHEN 0 THEN raw WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN raw END AS date, CASE id % 5 WHEN 0 THEN raw || '-01-01' WHEN 1 THEN strftime(d, '%Y-%m') || '-01' WHEN 2 THEN raw ELSE '' END AS key FROM d""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.year(d).cast("string")).when(k == 1, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"))).when(k == 2, g.day("o_orderdate")).when(k == 3, "unknown").otherwise(F.concat(F.lit("in "), F.year(d).cast("string")))
    rows = g.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), dates.clean_date(raw).alias("date"))
    return rows.withColumn("key", dates.date_key(F.col("date")))


@query("""WITH n AS (SELECT p_partkey::BIGINT AS id, CASE p_partkey % 8 WHEN 0 THEN 'He' WHEN 1 THEN 'my ' || p_name WHEN 2 THEN 'Bolt and ' || upper(p_name) WHEN 3 THEN '$ ' || p_size || ' million' WHEN 4 THEN 'this is a ' || p_name WHEN 5 THEN '' ELSE p_name END AS name, p_name FROM part)
SELECT id, id % 8 IN (0, 5) OR (id % 8 = 1 AND length(p_name) - length(replace(p_name, ' ', '')) <= 1) AS referring, id % 8 IN (2, 3) AS phrase FROM n""")
def pronoun_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, P13."""
    k = F.col("p_partkey") % 8
    name = F.when(k == 0, "He").when(k == 1, F.concat(F.lit("my "), "p_name")).when(k == 2, F.concat(F.lit("Bolt and "), F.upper("p_name"))).when(k == 3, F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(" million"))).when(k == 4, F.concat(F.lit("this is a "), "p_name")).when(k == 5, "").otherwise(F.col("p_name"))
    return g.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), text.is_referring(name).alias("referring"), text.is_phrase(name).alias("phrase"))


@query("""SELECT event_id::BIGINT AS id, 'user ' || user_id AS subject, event_type AS predicate, 'thing ' || json_extract_string(props, '$.k') AS object, least(greatest(value, 0), 1) AS confidence FROM events WHERE event_type <> 'error' AND value >= 0.5""")
def validated_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an extractor, parsed and validated; errors come negated and are dropped."""
    e = g.table(spark, sf_dir, "events")
    triple = F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("thing "), F.get_json_object("props", "$.k")).alias("object"), (F.col("event_type") == "error").alias("negated"), F.col("value").alias("confidence"))
    # a second triple of a thing with itself never passes
    loop = F.struct(F.lit("x y").alias("subject"), F.lit("is").alias("predicate"), F.lit("X Y").alias("object"), F.lit(False).alias("negated"), F.lit(1.0).alias("confidence"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(triple, loop).alias("triples"))), F.lit("\n```"))
    rows = e.select(F.col("event_id").cast("bigint").alias("id"), extract.parse_extraction(reply).alias("extraction"))
    return extract.triple_rows(rows, extract.Rules(least_confidence=0.5, drop_negated=True)).select("id", "subject", "predicate", "object", "confidence")


@query("""SELECT page_id::BIGINT AS page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25."""
    return g.table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), text.strip_html(F.col("html")).alias("text"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26."""
    return g.table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), text.html_lines(F.col("html")).alias("lines"))


@query("SELECT conv_id::BIGINT AS conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def session_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    return render_sessions(g.table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("bigint")), ["conv_id"])


_STOP = ", ".join(f"'{w}'" for w in lexical.STOP)


def _stem(c: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_-]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), lambda w: regexp_replace(w, '{lexical.STEM}', '\1'))"


@query(rf"""WITH d AS (SELECT doc_id::BIGINT AS id, {_stem('text')} AS ws FROM documents), i AS (SELECT id, len(ws) AS length, unnest(ws) AS term FROM d), tf AS (SELECT id, length, term, count(*) AS tf FROM i GROUP BY 1, 2, 3),
q AS (SELECT item_id::BIGINT AS query_id, unnest(list_distinct({_stem('text')})) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
x AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * length / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) SELECT query_id, id, rank::INT AS rank FROM r WHERE rank <= 10""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against all documents."""
    docs = g.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    asked = g.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("query_id"), "text")
    return lexical.search(asked, docs, 10).select("query_id", "id", "rank")


@query(r"""SELECT item_id::BIGINT AS id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[?,.!]+|[?,.!]+$', '', 'g')), lambda w: length(w) > 2) AS keywords FROM benchmark""")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    return g.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("id"), text.fallback_keywords(F.col("text")).alias("keywords"))


@query()
def term_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, S18."""
    from graphloom.functions.vectors import TermHashEmbedder, embedded

    return g.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("id"), embedded(TermHashEmbedder(16), F.col("text")).alias("embedding"))


@query("SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, CASE turn % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'TIE' END AS verdict, turn % 4 = 0 AS correct, turn % 5 = 0 AS refused FROM conversations")
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what judges write after each turn."""
    t = F.col("turn")
    v = F.when(t % 3 == 0, "so.\nVERDICT: A").when(t % 3 == 1, "Verdict: **tie**").otherwise("neither is better")
    c = F.when(t % 4 == 0, "correct.").when(t % 4 == 1, "INCORRECT").otherwise("perhaps")
    r = F.when(t % 5 == 0, "The question is Unanswerable here").otherwise("Paris")
    return g.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), t.cast("bigint").alias("turn"), text.verdict(v).alias("verdict"), text.judged_correct(c).alias("correct"), text.is_refusal(r).alias("refused"))
