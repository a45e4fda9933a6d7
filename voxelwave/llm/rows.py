"""Columns of any input by exact name, so that extra columns may have any names: dots, other cases, names used inside operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.runtime import cut

#: Rows of a table of short rows that may be broadcast; more are joined by a shuffle.
FEW = 1 << 16


def plain(df: DataFrame) -> DataFrame:
    """The same columns, named c0_, c1_, ... by place."""
    return df.toDF(*(f"c{i}_" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``plain(df)`` calls a column of ``df``."""
    return f"c{df.columns.index(name)}_"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone."""
    return plain(df).select(*(F.col(place(df, n)).alias(n) for n in names))


def bounded(df: DataFrame) -> DataFrame:
    """``df`` written, to be joined by a broadcast if it has at most FEW rows."""
    out = cut(df, "sizes")
    return F.broadcast(out) if out.count() <= FEW else out
