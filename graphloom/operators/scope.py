"""Tenancy: a realm is a partition of storage, a space a group in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "__all__"


def in_scope(df: DataFrame, realm: str | None = None, space: str | None = None) -> DataFrame:
    """Rows of a realm and space; ``ALL``, or None, is every space. Both are partition columns on disk, so this prunes directories."""
    if realm is not None:
        df = df.where(F.col("realm") == realm)
    if space is not None and space != ALL:
        df = df.where(F.col("space") == space)
    return df


def space_for(explicit: str | None, of_metadata: str | None, default: str) -> str:
    """The space to write to; the wildcard is for reading only."""
    space = explicit or of_metadata or default
    if space == ALL:
        raise ValueError(f"{ALL} is for queries; nothing can be written to it")
    return space
