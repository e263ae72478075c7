"""Tables of the property graph, and what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.errors import SchemaError

META = "struct<source:string,category:string,collection:string,document:string,page:int,paragraph:int>"
DOCUMENTS = f"realm string, space string, id bigint, text string, meta {META}, doc_key string, content_hash string, extra map<string,string>, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"
ENTITIES = "realm string, space string, id bigint, name string, type string, description string, aliases array<string>, dormant_since timestamp_ntz, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"
COMMUNITIES = "realm string, space string, id bigint, key string, title string, summary string, level int, rating double, findings array<struct<summary:string,explanation:string>>, size int, built_at timestamp_ntz, embedding array<float>"
RELATIONS = "realm string, space string, id bigint, from_id bigint, to_id bigint, relation_type string, description string, sources array<bigint>, weight int, negated boolean, confidence double, valid_from string, valid_to string, t_created string, t_expired string, superseded_by bigint, dormant_since timestamp_ntz, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"
MENTIONS = "realm string, space string, from_id bigint, to_id bigint"
MEMBERS = "realm string, space string, community_id bigint, entity_id bigint"
AUDIT = "realm string, batch bigint, table string, operation string, id bigint, at timestamp_ntz"
TABLES = {"documents": DOCUMENTS, "entities": ENTITIES, "communities": COMMUNITIES, "relations": RELATIONS, "doc_mentions": MENTIONS, "community_members": MEMBERS, "audit": AUDIT}

EXTRACTED_ENTITY = "struct<name:string,type:string,description:string,aliases:array<string>>"
EXTRACTED_TRIPLE = "struct<subject:string,predicate:string,object:string,description:string,negated:boolean,confidence:double,valid_from:string,valid_to:string>"
EXTRACTION = f"struct<entities:array<{EXTRACTED_ENTITY}>,triples:array<{EXTRACTED_TRIPLE}>>"
#: The row that every channel of retrieval gives.
TRIPLE = "query_id bigint, src_id string, tgt_id string, edge_id bigint, src_key bigint, tgt_key bigint, relation_type string, description string, weight int, negated boolean, confidence double, valid_from string, valid_to string, t_created string, t_expired string, superseded_by bigint, asserted_at string, hops int"


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the graph by its name."""
    if name not in TABLES:
        raise SchemaError(f"no table {name!r}")
    return spark.createDataFrame([], TABLES[name])


def check_columns(df: DataFrame, ddl: str) -> DataFrame:
    """``df``, if it has the columns of the schema with their types."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in df.sparkSession.createDataFrame([], ddl).schema}
    wrong = [f"{n} {t}" for n, t in want.items() if have.get(n) != t]
    if wrong:
        raise SchemaError("missing or of another type: " + ", ".join(wrong))
    return df


def check_width(df: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """``df``, if all its vectors have that width; one is enough to raise."""
    if df.where(F.size(column) != width).limit(1).count():
        raise SchemaError(f"{column} holds a vector whose width is not {width}")
    return df


def repeated_names(entities: DataFrame) -> DataFrame:
    """Names, in lower case, that several entities of one space share: must be empty."""
    return entities.groupBy("realm", "space", F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
