"""Ranking and size checks shared by the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A side with at most this many narrow rows may be broadcast (well under 100 MB).
SMALL_ROWS = 500_000


def top_k(df: DataFrame, by: list[str] | str, score: str, k: int, tie: str) -> DataFrame:
    """The k best rows per group with their rank ``rk``.

    Spark plans this as WindowGroupLimit: every task keeps k rows per group before the
    shuffle, so a group holding most of the rows costs no more than any other.
    """
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc_nulls_last())
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def fits(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Does ``df`` hold at most ``rows`` rows? Reads no more than rows+1 of them."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df
