from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *texts, start=1):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, start)], DOCS)


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect() if cols else df.collect()))


def clashing(df):
    """With columns of names that operators use inside, and in another case."""
    for c in ("key", "n", "cell", "bands", "sig", "rep", "hit", "accepted", "bin", "shard", "piece", "digest", "copy", "head_1", "size", "place", "bitmap", "ids", "license", "items"):
        df = df.withColumn(c, F.lit("x"))
    return df
