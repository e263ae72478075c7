"""Readers and writers: texts, transcripts, benchmark sessions, Parquet; JSON and CSV results; versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.operators.errors import SchemaError
from graphloom.operators.schema import check_columns


def _name():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, position, text) of whole text files; the number that a name begins with is its place in time, null for none."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(_name().alias("name"), F.col("value").alias("text"))
    return df.select("name", F.expr("try_cast(nullif(regexp_extract(name, '^([0-9]+)', 1), '') as bigint)").alias("position"), "text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(sector, code, year, quarter, company, text) of JSON files named sector-CODE-year-quarter.json; cleaned content before raw."""
    df = spark.read.schema("company_name string, stock_code string, cleaned_content string, raw_content string").json(path, multiLine=True, pathGlobFilter="*.json").withColumn("name", _name())
    part = lambda k: F.regexp_extract("name", r"^(.+)-([^-]+)-([0-9]{4})-([^-.]+)\.json$", k)
    return df.select(part(1).alias("sector"), part(2).alias("code"), F.expr("try_cast(regexp_extract(name, '-([0-9]{4})-[^-]+$', 1) as int)").alias("year"), part(4).alias("quarter"), F.col("company_name").alias("company"), F.coalesce("cleaned_content", "raw_content").alias("text"))


SESSIONS = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def read_sessions(spark: SparkSession, path: str, kind: str | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """Benchmark instances, of one type if asked, n of them in an order that the seed decides; the same at any partitioning."""
    df = spark.read.schema(SESSIONS).json(path, multiLine=True)
    if kind is not None:
        df = df.where(F.col("question_type") == kind)
    return df if n is None else df.orderBy(F.xxhash64(F.lit(seed), "question_id"), "question_id").limit(n)


def render_sessions(turns: DataFrame, by: list[str], date: str | None = None) -> DataFrame:
    """Turns (by, turn, role, text) of each session as one text, a line for each, in order; a dated header if there is a date column."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"])
    body = F.array_join(lines, "\n")
    if date is None:
        return turns.groupBy(*by).agg(body.alias("text"))
    return turns.groupBy(*by).agg(body.alias("text"), F.first(date).alias(date)).withColumn("text", F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("[Conversation on "), date, F.lit("]\n"), "text")).otherwise(F.col("text")))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (source, target) of GraphML files, by Spark's own XML reader."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path).select(F.col("_id").alias("id"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path).select(F.col("_source").alias("source"), F.col("_target").alias("target"))
    return nodes, edges


def graphml_keywords(spark: SparkSession, path: str, key: str, separators: str = "[,;]|<SEP>") -> DataFrame:
    """(keyword, n) over the edges of GraphML files: how often each keyword stands in the data element of that key, in lower case."""
    data = "data array<struct<_VALUE:string,_key:string>>"
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    said = edges.select(F.explode("data").alias("d")).where(F.col("d._key") == key).select(F.explode(F.split("d._VALUE", separators)).alias("keyword"))
    return said.select(F.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''").groupBy("keyword").agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, expect: int | None = None) -> int:
    """Writes with a header and reads back: the number of rows, which must be ``expect`` if given."""
    df.write.mode("errorifexists").csv(path, header=True, escape='"')
    n = df.sparkSession.read.csv(path, header=True, multiLine=True, escape='"').count()
    if expect is not None and n != expect:
        raise SchemaError(f"{n} rows written, {expect} expected")
    return n


class Store:
    """Tables by realm and space in a directory. A write makes a new version and then moves a pointer, so what is being read is never overwritten."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        at = self._path(f"{self.path}/{table}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.versions(table)
        if not found:
            raise SchemaError(f"no table {table!r}")
        at = f"{self.path}/{table}/v={found[-1] if version is None else version}"
        schema = self.spark.read.parquet(at).schema
        for f in schema:
            if f.name in ("realm", "space"):  # directory names are strings, whatever they look like
                f.dataType = StringType()
        return self.spark.read.schema(schema).parquet(at)

    def write(self, table: str, df: DataFrame, schema: str | None = None, keep: int = 2) -> int:
        """The new version's number; the last ``keep`` versions stay for those who are reading."""
        if schema is not None:
            df = check_columns(df, schema)
        found = self.versions(table)
        new = found[-1] + 1 if found else 0
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        by = [c for c in ("realm", "space") if c in df.columns]
        df.write.partitionBy(*by).parquet(draft) if by else df.write.parquet(draft)
        self._fs.mkdirs(self._path(f"{self.path}/{table}"))
        if not self._fs.rename(self._path(draft), self._path(f"{self.path}/{table}/v={new}")):
            self._fs.delete(self._path(draft), True)
            raise SchemaError(f"version {new} of {table!r} is there already")
        for v in [*found, new][:-keep]:
            self._fs.delete(self._path(f"{self.path}/{table}/v={v}"), True)
        return new

    def append(self, log: str, df: DataFrame, number: int) -> bool:
        """Adds a numbered batch to a log, a directory put in place by one rename; False, without effect, if it is there already. Earlier batches are not touched."""
        at = self._path(f"{self.path}/{log}/batch={number}")
        if self._fs.exists(at):
            return False
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        self._fs.mkdirs(self._path(f"{self.path}/{log}"))
        if not self._fs.rename(self._path(draft), at):
            self._fs.delete(self._path(draft), True)
            return False
        return True

    def log(self, log: str) -> DataFrame:
        """All batches of a log, with their number as ``batch``."""
        return self.spark.read.parquet(f"{self.path}/{log}")

    def drop_realm(self, realm: str) -> None:
        """New versions of all tables without the realm."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        for t in names:
            if not t.startswith(".") and self.versions(t):
                df = self.read(t)
                if "realm" in df.columns:
                    self.write(t, df.where(F.col("realm") != realm), keep=1)
