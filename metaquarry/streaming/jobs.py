"""Running streams: batch-wise sinks that may be retried, upserts, and the guard stream."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.operators.audit import gate
from metaquarry.sources.records import path_exists

STREAM_CONF = {
    # time to live needs processing time; without this, availableNow runs never end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


@contextmanager
def stream_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Write every micro-batch to its own folder ``batch=<id>`` of ``path``.

    A retried batch overwrites its own folder, so each input row counts once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def run_to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all data there is now, then stop."""
    with stream_conf(stream.sparkSession):
        start_to_batches(stream, path, checkpoint, mode).awaitTermination()


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    if schema is not None and not path_exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(path)


def read_current(spark: SparkSession, path: str, key: str, version: str | None = None) -> DataFrame:
    """The current row per key of a folder of batches: highest version, then latest batch.

    Upserts are merged when read; a batch writes only its own rows however large the
    table is. ``compact`` folds the batches when reading gets slow.
    """
    order = ([F.col(version).desc()] if version else []) + [F.col("batch").desc()]
    w = Window.partitionBy(key).orderBy(*order)
    rows = read_batches(spark, path)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def stream_upsert(
    updates: DataFrame, path: str, checkpoint: str, key: str, version: str, then: str | None = None
):
    """Keep the newest row per key of a stream of updates; idempotent by batch id.

    Rows of one version are ordered by ``then``, and last by a hash of the whole row, so a
    retried batch writes the same row.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        ties = [F.col(then).desc()] if then else []
        w = Window.partitionBy(key).orderBy(F.col(version).desc(), *ties, F.xxhash64(*rows.columns))
        newest = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with stream_conf(updates.sparkSession):
        writer = updates.writeStream.option("checkpointLocation", checkpoint)
        writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def compact(spark: SparkSession, path: str, target: str, key: str, version: str | None = None) -> None:
    """Write the current rows of ``path`` as the first batch of a new folder."""
    read_current(spark, path, key, version).write.parquet(f"{target}/batch=0")


def stream_guard(statements: DataFrame) -> DataFrame:
    """Verdict and reply per statement; stateless."""
    return gate(statements)
