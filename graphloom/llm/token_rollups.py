"""Token counts as rollups kept by signed deltas.

A rollup store holds additive totals (documents, tokens) by source, language and tokenizer version. A batch brings changes: inserts, deletes and revised counts; each
becomes signed deltas (a revision is minus the old and plus the new count), which are summed by key before anything is written. A batch is one directory, put in
place by a single rename, so it is there whole or not at all; a batch number that is there already changes nothing, whoever commits it and
however often. Totals are a sum over the batches, or over a compacted base and the batches after it; documents are never read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import cut, doc_texts, shared_dir, table

KEY = ("source", "lang", "tokenizer")
CHANGES = "source string, lang string, tokenizer string, op string, tokens bigint, old_tokens bigint"
ROLLUP = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

#: Tokenizer versions, as counts over the column ``text``: white-space words, and runs of letters and digits or single other characters.
TOKENIZERS: dict[str, str] = {"words-1": r"\S+", "pieces-1": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}


def count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("bigint")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed (docs, tokens) by key, summed. ``op`` is insert, delete or revise; a null count is zero, null key parts are keys of their own."""
    new, old = F.coalesce("tokens", F.lit(0)).cast("bigint"), F.coalesce("old_tokens", F.lit(0)).cast("bigint")
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    docs = F.when(known == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(known == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    rows = changes.select(*KEY, docs.cast("bigint").alias("docs"), tokens.alias("tokens"))
    return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class RollupStore:
    """Batches of deltas in a directory that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, kind: str) -> list[int]:
        root = self._at(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[len(kind) + 1 :]) for n in names if n.startswith(f"{kind}=") and n[len(kind) + 1 :].isdigit())

    def batches(self) -> list[int]:
        """Batch numbers that are committed, those in the base included."""
        base = self._children("base")
        inside: list[int] = []
        if base:
            inside = [r[0] for r in self.spark.read.parquet(f"{self.path}/base={base[-1]}/batches").collect()]
        return sorted({*inside, *self._children("batch")})

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Commits the batch; False, without any effect, if that number was committed before."""
        if batch < 0:
            raise ValueError("batch numbers are not negative")
        if batch in self.batches():
            return False
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(draft)
        done = self._fs.rename(self._at(draft), self._at(f"{self.path}/batch={batch}"))
        nested = self._at(f"{self.path}/batch={batch}/{draft.rpartition('/')[2]}")
        if self._fs.exists(nested):  # another writer was first: a rename onto a directory moves into it
            self._fs.delete(nested, True)
            return False
        if not done:
            self._fs.delete(self._at(draft), True)
            if batch in self.batches():
                return False
            raise OSError(f"batch {batch} could not be put in place")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all keys; those whose documents and tokens have all gone are left out."""
        base = self._children("base")
        parts = [f"{self.path}/base={base[-1]}/totals"] if base else []
        covered = {r[0] for r in self.spark.read.parquet(f"{self.path}/base={base[-1]}/batches").collect()} if base else set()
        parts += [f"{self.path}/batch={b}" for b in self._children("batch") if b not in covered]
        rows = self.spark.read.schema(ROLLUP).parquet(*parts) if parts else self.spark.createDataFrame([], ROLLUP)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> int:
        """Sums all batches into a new base. What the base before covered is dropped only now, so that whoever holds ``totals()`` from before one compaction can still read them."""
        batches = self.batches()
        last = (self._children("base") or [-1])[-1]
        if not batches:
            return last
        before = {r[0] for r in self.spark.read.parquet(f"{self.path}/base={last}/batches").collect()} if last >= 0 else set()
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch bigint").coalesce(1).write.parquet(f"{draft}/batches")
        self._fs.rename(self._at(draft), self._at(f"{self.path}/base={last + 1}"))
        for b in self._children("batch"):
            if b in before:
                self._fs.delete(self._at(f"{self.path}/batch={b}"), True)
        for b in self._children("base"):
            if b < last:
                self._fs.delete(self._at(f"{self.path}/base={b}"), True)
        return last + 1


def document_changes(docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS)) -> DataFrame:
    """Counts of every document under every tokenizer: (doc_id, source, lang, tokenizer, tokens, copy). ``copy``: an equal text has a lesser doc_id.

    * Null and empty texts count zero tokens and are copies of each other; a null doc_id, source or lang is a value like any other, nulls first.
    * Repeated rows count each; of rows that tie in doc_id and text, all are copies or none is.
    * Texts of any length are counted whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = doc_texts(docs, "doc_id", "text", "source", "lang")
    # what is compared for equality is a 256-bit digest: texts do not travel
    counted = rows.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2("text", 256).alias("digest"), F.array(*[count(F.col("text"), t) for t in tokenizers]).alias("counts"))
    least = F.first("doc_id").over(Window.partitionBy("digest").orderBy(F.asc_nulls_first("doc_id")))
    marked = counted.withColumn("copy", ~F.col("doc_id").eqNullSafe(least))
    return marked.select("doc_id", "source", "lang", "copy", F.posexplode("counts").alias("k", "tokens")).select("doc_id", "source", "lang", F.element_at(F.array(*map(F.lit, tokenizers)), F.col("k") + 1).alias("tokenizer"), "tokens", "copy")


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over the documents: all inserted under the first tokenizer version; all inserted under the second; exact
    copies deleted under both; counts of the second revised to leave out the first word of each text; and the deletes sent once more, under their old number."""
    docs = cut(document_changes(table(spark, sf_dir, "documents")))
    store = RollupStore(spark, f"{shared_dir(spark)}/token-rollups-{uuid.uuid4().hex}")
    first, second = TOKENIZERS
    one = docs.where(F.col("tokenizer") == first)
    two = docs.where(F.col("tokenizer") == second)
    none = F.lit(None).cast("bigint").alias("old_tokens")
    gone = docs.where("copy").select(*KEY, F.lit("delete").alias("op"), "tokens", none)
    store.commit(0, one.select(*KEY, F.lit("insert").alias("op"), "tokens", none))
    store.commit(1, two.select(*KEY, F.lit("insert").alias("op"), "tokens", none))
    store.commit(2, gone)
    store.commit(3, two.where("not copy").select(*KEY, F.lit("revise").alias("op"), F.greatest(F.col("tokens") - 1, F.lit(0)).alias("tokens"), F.col("tokens").alias("old_tokens")))
    store.commit(2, gone)
    store.compact()
    return store.totals()


OP8_SQL = """
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS pieces,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS FIRST) AS r
  FROM documents
)
SELECT source, lang, tokenizer, sum(1)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer, words AS tokens FROM d WHERE r = 1
  UNION ALL SELECT source, lang, 'pieces-1', greatest(pieces - 1, 0) FROM d WHERE r = 1
) GROUP BY 1, 2, 3
"""
