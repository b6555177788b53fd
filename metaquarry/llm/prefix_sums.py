"""Positions of documents on their source's token line, without one task per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A stretch of a source's line is meant to hold about this many documents.
STRETCH_ROWS = 4_096


def lay_out(docs: DataFrame, size: str, rows: int) -> DataFrame:
    """Add ``start``: the sum of ``size`` of all rows of the same source that come before.

    ``docs`` has source, doc_id, digest (a text made of hash digits) and ``size``. A source's
    rows follow each other by digest, so their order is a shuffle that reruns repeat. Each
    source is cut into stretches by the digest's first digits; sums run inside stretches and
    over the stretches' totals. ``rows`` is the number of rows.
    """
    digits = 1
    while 16**digits * STRETCH_ROWS < rows:
        digits += 1
    key = F.struct("source").alias("line")  # a struct, so that a null source equals itself
    cut = docs.withColumn("line", key).withColumn("stretch", F.substring("digest", 1, digits))
    inside = Window.partitionBy("line", "stretch").orderBy("digest", "doc_id", size)
    cut = cut.withColumn("inside", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    totals = cut.groupBy("line", "stretch").agg(F.sum(size).alias("total"))
    over = Window.partitionBy("line").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.withColumn("before", F.sum("total").over(over) - F.col("total")).drop("total")
    return (
        cut.join(before, ["line", "stretch"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("line", "stretch", "inside", "before")
    )


def digest(*values) -> F.Column:
    """Hash digits of the values of a row; the same in every run and every engine."""
    return F.md5(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("-")) for v in values]))
