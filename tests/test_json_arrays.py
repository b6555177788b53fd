"""Array files in splits: against json, with strings that look like structure."""

import json
import random

import pytest
from pyspark.sql import functions as F

from metaquarry.session import new_run_dir
from metaquarry.sources.json_arrays import _pieces, array_records, read_array

ODD = ['}', '{', '"', "\\", '\\"', "},{", '"}', "é𝒳", "a\nb", "", "[{", "\\\\\"}"]


def records(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice(ODD + ["word ", "x"]) for _ in range(rng.randrange(6)))
    return [
        {"id": i, word() + "k": word(), "in": {"a": [word(), {"b": word()}], "c": None}, "t": word() * rng.randrange(9)}
        for i in range(n)
    ]


def write(spark, texts):
    """Each text as one file."""
    path = new_run_dir(spark, "array-test")
    df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(len(texts))
    df.write.option("lineSep", "\n").text(path)
    return path


@pytest.fixture()
def small_splits(spark):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "700b")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_in_many_tasks(spark, small_splits, indent):
    rows = records(120)
    path = write(spark, [json.dumps(rows, indent=indent, ensure_ascii=indent is None)])
    assert _pieces(spark, path).rdd.getNumPartitions() > 10
    got = array_records(spark, path).orderBy("record").collect()
    assert [r["record"] for r in got] == list(range(120))
    assert [json.loads(r["text"]) for r in got] == rows


def test_several_files_and_a_record_over_many_splits(spark, small_splits):
    big = {"id": 0, "t": "} {" * 3_000}
    path = write(spark, [json.dumps([big, {"id": 1}]), json.dumps([{"id": 2, "t": "{"}]), "[]", "[ ]"])
    got = read_array(spark, path, "id long, t string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "} {" * 3_000), (1, None), (2, "{")]


def test_empty_files(spark):
    path = write(spark, ["[]"])
    assert read_array(spark, path, "id long").count() == 0
    df = read_array(spark, write(spark, ['[{"id": 1}, {"id": "x"}]']), "id long")
    assert sorted(r["id"] or 0 for r in df.select(F.col("id")).collect()) == [0, 1]
