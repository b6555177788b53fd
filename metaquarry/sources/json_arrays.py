"""Large JSON array files as many tasks.

A file that is one JSON array cannot be read line by line, and read whole it is one task. Here
Spark's text reader splits the file at closing braces, which it can do from any byte range.
Whether such a brace ends a record depends on all that stands before it: it does if it is
outside of strings and closes the outermost object. Strings are told by the number of quotes
before a piece, depth by the number of braces outside of strings, and records by the number of
pieces that came back to depth zero: three running sums, each within a byte range and over the
totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.session import cut_lineage

_RANGE = ["_file", "_range"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text before each closing brace, with its file, byte range and place in it."""
    return (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_range"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )


def _before(pieces: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all pieces of the file that come before."""
    valued = pieces.withColumn("_amount", amount)
    # one row for each byte range, computed once
    totals = cut_lineage(valued.groupBy(*_RANGE).agg(F.sum("_amount").alias("_total")))
    ranges = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*_RANGE, F.coalesce(F.sum("_total").over(ranges), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*_RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = valued.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = summed.join(F.broadcast(offsets), _RANGE)  # a file of a terabyte has some thousands of ranges
    return joined.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_amount", "_inside", "_offset")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): every object of the arrays in the files, numbered from 0."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes never end a string
    pieces = _before(_pieces(spark, path), F.regexp_count(plain, F.lit('"')).cast("long"), "_quotes")
    # what is outside of strings; one that goes on from before, or goes on behind, is cut off
    opened = F.when(F.col("_quotes") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain)
    bare = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    within = F.regexp_count(opened, F.lit('"')) % 2 == 1  # the brace is a character of a string
    step = F.regexp_count(bare, F.lit(r"\{")) - F.when(within, 0).otherwise(1)
    pieces = pieces.withColumns({"_step": step.cast("long"), "_brace": ~within})
    pieces = _before(pieces, F.col("_step"), "_depth")
    ends = F.col("_brace") & (F.col("_depth") + F.col("_step") == 0)
    pieces = _before(pieces.withColumn("_end", ends), F.col("_end").cast("long"), "record")
    part = F.struct("_range", "_at", F.concat("value", F.lit("}")).alias("text"), "_end")
    whole = pieces.groupBy("_file", "record").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    whole = whole.where(F.exists("_parts", lambda p: p["_end"]))  # what follows the last record has none
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    # the array's bracket, commas and blanks stand before the first brace
    return whole.select(F.col("_file").alias("file"), "record", F.regexp_replace(text, r"(?s)^[^{]*", "").alias("text"))


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that each hold one JSON array of objects, in UTF-8.

    Splits of ``spark.sql.files.maxPartitionBytes`` are read side by side. A record that is
    no valid JSON for the schema gives nulls, as in Spark's own reader.
    """
    rows = array_records(spark, path).select(F.from_json("text", schema).alias("row"))
    return rows.select("row.*")
