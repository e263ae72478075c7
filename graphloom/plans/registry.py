"""The engine's registered queries and their SQL equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import fusion_queries, graph_queries, indexing_queries, metric_queries, text_queries

_MODULES = (text_queries, graph_queries, fusion_queries, metric_queries, indexing_queries)


#: Bytes of tables on disk for each partition of a shuffle.
SHARE = 2 << 20
#: Up to which size, compressed, adaptive execution joins partitions: rows of a graph repeat themselves, and take forty times as much in a sort.
JOINED = "8m"


def table_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the files below a folder, from its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def _spread(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Partitions of a shuffle follow the input, so that what a task holds does not grow with it: as many as SHARE asks for, and no fewer than the session says; adaptive execution joins those that are small."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes(spark, sf_dir) // SHARE))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", parts)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _spread(v) for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_queries.flagship(spark, sf_dir)
