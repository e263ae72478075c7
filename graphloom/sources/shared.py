"""The folder that all executors share, and cutting lineage into it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh temporary folder only where it is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but in columns and compressed, for tables of many rows: a fraction of the room. Goes when the session's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def light(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, which was cut, marked for a broadcast if it has at most so many rows: they are counted, so a plan that knows no sizes need not shuffle the other side."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
