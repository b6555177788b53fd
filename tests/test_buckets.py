"""Upserts that rewrite only the buckets they change."""

import glob

import pytest
from pyspark.sql import functions as F

from metaquarry.session import new_run_dir
from metaquarry.sources.buckets import BucketTable, stream_into


@pytest.fixture()
def table(spark):
    rows = spark.range(200).select("id", F.col("id").alias("v"), F.lit(0).cast("long").alias("at"))
    return BucketTable.create(rows, new_run_dir(spark, "bucket-test"), "id", buckets=8)


def files(table, gen="*"):
    return set(glob.glob(f"{table.path.removeprefix('file:')}/data/gen={gen}/bucket=*/*.parquet"))


def rows(table):
    return {r["id"]: (r["v"], r["at"]) for r in table.read().collect()}


def test_untouched_buckets_keep_their_files(spark, table):
    before, gens = files(table), table.generations()
    one = spark.createDataFrame([(7, 70, 1), (7, 71, 2)], "id long, v long, at long")
    assert table.upsert(one, order_col="at") == 1
    assert before < files(table) and len({f.rsplit("/", 2)[1] for f in files(table, "1")}) == 1
    after = table.generations()
    assert sum(after[b] != gens[b] for b in gens) == 1
    want = {i: (i, 0) for i in range(200)} | {7: (71, 2)}
    assert rows(table) == want


def test_a_repeated_batch_changes_nothing_more(spark, table):
    change = spark.createDataFrame([(1, 5, 1), (500, 6, 1)], "id long, v long, at long")
    table.upsert(change, gen=1)
    first = rows(table)
    table.upsert(change, gen=1)
    assert rows(table) == first and first[500] == (6, 1) and len(first) == 201
    table.upsert(change.limit(0))
    assert rows(table) == first


def test_versions_and_streams(spark):
    base = new_run_dir(spark, "bucket-stream")
    start = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, v string, at long")
    table = BucketTable.create(start, f"{base}/t", "id", "at", buckets=4)
    for rows_ in ([(1, "old", 4), (3, "c", 1)], [(1, "new", 6), (3, "d", 1)]):
        spark.createDataFrame(rows_, start.schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(start.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream_into(stream, table, f"{base}/cp")
    assert {(r["id"], r["v"]) for r in table.read().collect()} == {(1, "new"), (2, "b"), (3, "d")}
    assert set(table.generations().values()) <= {0, 1, 2}


def test_empty_table(spark):
    table = BucketTable.create(spark.createDataFrame([], "id long, v string"), new_run_dir(spark, "bucket-none"), "id", buckets=4)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "x")], "id long, v string"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "x")]
