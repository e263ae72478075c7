"""What the corpus operators share: input guards, the cluster's shared folder, vectorised words."""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1_000_000
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh temporary one only where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def temp_name(stem: str, taken: Iterable[str]) -> str:
    """A column name that clashes with none of ``taken``, in Spark's case-insensitive sense."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach a kernel; a null text is an empty one."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *[docs[c] for c in more])


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


@functools.cache
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[U64(1)], np.full(n - 1, b, U64)]).cumprod(dtype=U64) for b in (base, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2**64 of an odd base and of its inverse, at least ``n`` of them."""
    return _powers(1 << max(20, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def word_spans(cp: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word characters, none across texts; and the first word of each text."""
    inside = is_word[cp]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(cp)]
    first[edge] = inside[edge]
    begins = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, starts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of letters and digits) of each text, and each text's first word."""
    cp, starts = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    begins, ends, words = word_spans(cp, starts, alnum_table())
    up, down = powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * up[: len(cp)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U64)), words


def pandas_batches(batches: Iterator, column: str = "text") -> Iterator:
    """Cuts pandas batches into pieces of about CHUNK_CHARS characters of ``column``."""
    for pdf in batches:
        texts = pdf[column].tolist()
        for a, b in chunks(texts):
            yield pdf.iloc[a:b], texts[a:b]


def arrow_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches into pieces of about CHUNK_CHARS characters of ``column``. Ids stay in Arrow: pandas has no nulls beside whole numbers of 64 bits."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for a, b in chunks(texts):
            yield batch.slice(a, b - a), texts[a:b]


def arrow_lists(values: np.ndarray, starts: np.ndarray):
    """An Arrow list column over flat values."""
    kind = pa.list_ if starts[-1] < 2**31 else pa.large_list
    cls = pa.ListArray if starts[-1] < 2**31 else pa.LargeListArray
    del kind
    return cls.from_arrays(pa.array(starts.astype(np.int32 if cls is pa.ListArray else np.int64)), pa.array(values))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Alternating large-star and small-star passes; each is two shuffles of the edges and ends in the shared
    folder. Hubs are partitions of a window, which spills, and never lists in memory.
    """
    from pyspark.sql import Window

    now = cut(edges.select("a", "b").where("a <> b").distinct())
    count = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = count(now)  # edges that are stars about least nodes already stay as they are
    by = Window.partitionBy("u")
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.distinct().withColumn("m", F.min("v").over(by))
        now = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        state = count(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def package_path() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bits of the bitmap of ``likely_in``: half a megabyte at any size of the data.
BITS = 22


def likely_in(rows: DataFrame, key, wanted: DataFrame) -> DataFrame:
    """Rows whose bigint ``key`` may be in the only column of ``wanted``: all that are, and some that are not.

    A filter before a join, so that rows without a partner are not shuffled. The bitmap that is broadcast has 2**BITS bits whatever the
    size of the tables; the more keys are wanted the less it filters, and nothing is ever lost.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS)) + 1
    at = place(F.col(wanted.columns[0]))
    b, p, m = (temp_name(x, rows.columns) for x in ("bucket", "place", "bitmap"))
    maps = wanted.select(F.bitmap_bucket_number(at).alias(b), F.bitmap_bit_position(at).alias(p)).groupBy(b).agg(F.bitmap_construct_agg(p).alias(m))
    held = rows.withColumn(p, place(key)).withColumn(b, F.bitmap_bucket_number(p)).join(F.broadcast(maps), b)
    spot = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.substring(F.col(m), F.expr(f"int(bitmap_bit_position(`{p}`) div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    return held.where(F.call_function("getbit", byte, (spot % 8).cast("int")) == 1).select(*rows.columns)
