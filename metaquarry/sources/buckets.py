"""Keyed tables of which an upsert rewrites only the buckets it changes.

Rows lie in hash buckets of their key. An upsert reads the buckets that hold its keys, merges
them with the changes and writes them as a new generation, next to the old ones; a small entry
in the manifest then makes it current. Readers take each bucket's newest generation, so they see
either all of an upsert or nothing, and one that is repeated after a failure overwrites itself.
One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.sources.records import upsert
from metaquarry.streaming.jobs import stream_conf

MANIFEST = "gen long, buckets int, written array<int>, row_schema string"


class BucketTable:
    """A table of buckets below ``path``, with one row per value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str | None = None):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, version: str | None = None, buckets: int = 256) -> "BucketTable":
        """Write ``rows``, whose keys differ, as the first generation."""
        made = BucketTable(rows.sparkSession, path, key, version)
        made._write(rows, 0, buckets)
        return made

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, gen: int, buckets: int) -> None:
        target = f"{self.path}/data/gen={gen}"
        placed = rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(target)
        found = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())]))
        # at most as many values as buckets
        written = sorted(r[0] for r in found.parquet(target).select("bucket").distinct().collect())
        entry = self.spark.createDataFrame([(gen, buckets, written, rows.schema.json())], MANIFEST)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/entry={gen}")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def generations(self) -> dict[int, int]:
        """The newest generation of every bucket that has rows."""
        each = self._manifest().select("gen", F.explode("written").alias("bucket"))
        return {r["bucket"]: r["gen"] for r in each.groupBy("bucket").agg(F.max("gen").alias("gen")).collect()}

    def _newest(self):
        return self._manifest().orderBy(F.col("gen").desc()).first()

    def _read(self, gens: dict[int, int], schema: T.StructType) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/gen={gen}/bucket={bucket}" for bucket, gen in sorted(gens.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.generations(), T.StructType.fromJson(json.loads(self._newest()["row_schema"])))

    def upsert(self, changes: DataFrame, gen: int | None = None, order_col: str | None = None) -> int:
        """Insert or replace by key; returns the number of buckets that were rewritten.

        With a ``version`` the highest one of a key wins, changes before what is stored;
        without, the last change (by ``order_col`` or position) replaces. ``gen`` numbers the
        upsert, for batches that may be repeated: one that was written already is written
        again from what was current before it.
        """
        newest = self._newest()
        gen = newest["gen"] + 1 if gen is None else gen
        buckets, schema = newest["buckets"], T.StructType.fromJson(json.loads(newest["row_schema"]))
        touched = {r[0] for r in changes.select(self._bucket(buckets).alias("b")).distinct().collect()}
        before = self._manifest().where(F.col("gen") < gen).select("gen", F.explode("written").alias("bucket"))
        gens = {r["bucket"]: r["gen"] for r in before.groupBy("bucket").agg(F.max("gen").alias("gen")).collect()}
        current = self._read({b: g for b, g in gens.items() if b in touched}, schema)
        extra = [c for c in changes.columns if c not in schema.names]  # such as the order
        for c in extra:
            current = current.withColumn(c, F.lit(None).cast(changes.schema[c].dataType))
        merged = upsert(current, changes, self.key, self.version, order_col).select(*schema.names)
        self._write(merged, gen, buckets)
        return len(touched)


def stream_into(
    updates: DataFrame, table: BucketTable, checkpoint: str, first_gen: int = 1, order_col: str | None = None
) -> None:
    """Upsert every micro-batch of a stream, up to its end, as generation ``first_gen`` + batch.

    A batch that is repeated writes the same generation, so the table's generations from
    ``first_gen`` on belong to this stream and its checkpoint.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        table.upsert(rows, gen=first_gen + batch_id, order_col=order_col)

    with stream_conf(updates.sparkSession):
        writer = updates.writeStream.option("checkpointLocation", checkpoint)
        writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
