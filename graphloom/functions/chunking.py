"""Packing of paragraphs into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LEAST = 2000, 200, 40


def pack_paragraphs(text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, headings: bool = False) -> list[str]:
    """Lines of at least ``least`` characters packed into chunks of up to ``chunk``.

    A chunk that is full hands its last ``overlap`` characters on, from the first sentence that begins in them if there is one. A line longer than a
    chunk is never split; lines that begin with "==" are headings and left out unless asked for.
    """
    out: list[str] = []
    held = ""
    for raw in (text or "").split("\n"):
        line = raw.strip()
        if not line or len(line) < least or (line.startswith("==") and not headings):
            continue
        if not held:
            held = line
        elif len(held) + 1 + len(line) <= chunk:
            held += "\n" + line
        else:
            out.append(held)
            rest = held[-overlap:] if overlap > 0 else ""
            sentence = rest.find(". ")
            if -1 < sentence < len(rest) - 2:
                rest = rest[sentence + 2 :]
            held = (rest + "\n" + line).strip() if rest else line
    return [*out, held] if held else out


def chunked(text: Column, chunker=pack_paragraphs) -> Column:
    """The chunks of a text, by any function from a text to strings."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunker(t) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(text)


def numbered_chunks(docs: DataFrame, text: str = "text", chunker=pack_paragraphs) -> DataFrame:
    """A row for each chunk: the document's other columns, ``paragraph`` from 1, ``text``."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunked(F.col(text), chunker)).alias("paragraph", "text")).withColumn("paragraph", F.col("paragraph") + 1)
