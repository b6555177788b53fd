"""Reading, writing, upserting, publishing and looking up record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.operators.filters import build_filter
from metaquarry.sources.json_arrays import read_array


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = False
) -> DataFrame:
    """Rows of JSON array files, read in splits, or of JSON lines; a path that does not exist
    has no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path) if lines else read_array(spark, path, schema)


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write as JSON lines or Parquet, one file per partition."""
    df.write.format(fmt).mode("errorifexists").save(path)


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    key: str,
    version_col: str | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Insert or replace by key; the result has one incoming row per key at most.

    Of several incoming rows of a key the last one counts: by ``order_col``, or by position
    in ``incoming``. Without ``version_col`` it always replaces. The current rows are only
    filtered, so a small change set is broadcast and the large side is not shuffled. With
    ``version_col`` the highest version of a key wins, incoming before current on a tie.
    """
    place = F.col(order_col) if order_col else F.monotonically_increasing_id()
    placed = incoming.withColumn("_at", place)
    if version_col is None:
        whole = F.struct(*[F.col(c) for c in incoming.columns])
        last = placed.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, "_at").alias("_row")).select("_row.*")
        kept = current.join(incoming.select(key), key, "left_anti")
        return kept.unionByName(last)
    none = F.lit(None).cast(placed.schema["_at"].dataType)
    both = current.withColumns({"_src": F.lit(0), "_at": none}).unionByName(placed.withColumn("_src", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(
        F.col(version_col).desc(), F.col("_src").desc(), F.col("_at").desc()
    )
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_src", "_at", "_n")


def lookup(
    df: DataFrame, key: str, fields: list[str], filters: dict | None = None, ids=None
) -> DataFrame:
    """Rows by filter and/or by key (a DataFrame of keys, or a list), projected."""
    rows = df.where(build_filter(filters))
    if isinstance(ids, DataFrame):
        rows = rows.join(ids.select(key), key, "left_semi")
    elif ids is not None:
        rows = rows.where(F.col(key).isin(list(ids)))
    return rows.select(*fields)


POINTER_SCHEMA = "alias string, target string, published_at timestamp"


def resolve(spark: SparkSession, pointers: str, alias: str) -> str:
    """What an alias stands for; an alias never published stands for itself."""
    if not path_exists(spark, pointers):
        return alias
    log = spark.read.schema(POINTER_SCHEMA).parquet(pointers).where(F.col("alias") == alias)
    newest = log.orderBy(F.col("published_at").desc()).select("target").first()
    return newest[0] if newest else alias


def publish(spark: SparkSession, pointers: str, alias: str, target: str) -> str:
    """Point an alias at a data path and at a view of it: created, unchanged or updated.

    The pointer table is an append-only log; the last entry of an alias counts.
    """
    before = resolve(spark, pointers, alias)
    if before == target:
        outcome = "unchanged"
    else:
        outcome = "created" if before == alias else f"updated ({before} -> {target})"
        entry = spark.range(1).select(
            F.lit(alias).alias("alias"),
            F.lit(target).alias("target"),
            F.current_timestamp().alias("published_at"),
        )
        entry.write.mode("append").parquet(pointers)
    spark.read.parquet(target).createOrReplaceTempView(alias)
    return outcome
