import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaquarry.functions import words
from metaquarry.functions.text import tokens
from metaquarry.operators import bm25 as bm
from metaquarry.operators.catalogs import build_column_catalog
from metaquarry.sources.metadata import generate_columns, generate_tables

random.seed(7)
ODD = ["a", "B", "_", "7", "é", "İ", "Σ", "ς", "字", "𝒜", "😀", "‍", ".", " ", "\n", "٣", "ß", "́", "Ⅷ", "²"]
TEXTS = ["", "a b a", *("".join(random.choices(ODD, k=k)) for k in (1, 3, 10, 90) * 60)]


@pytest.mark.parametrize("step_texts, step_bytes", [(1_000, 4 << 20), (3, 40)])
def test_listed_words_are_those_of_the_pattern(spark, monkeypatch, step_texts, step_bytes):
    monkeypatch.setattr(words, "STEP_TEXTS", step_texts)
    monkeypatch.setattr(words, "STEP_BYTES", step_bytes)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, s string")
    rows = df.select("id", F.lower("s").alias("low"), tokens(F.col("s")).alias("all")).orderBy("id").collect()
    listed = sorted({w for r in rows for w in r["all"]})[::2]
    chars = words.unpacked(words.word_chars(spark))
    for texts in (pa.array([r["low"] for r in rows]), pa.array(["x", *(r["low"] for r in rows)], pa.large_string())[1:]):
        got = words.count_listed(texts, chars, ["", *listed]).to_pylist()
        for r, g in zip(rows, got, strict=True):
            assert g["doc_len"] == len(r["all"])
            met = [("", 1), *((w, r["all"].count(w)) for w in listed if w in r["all"])]
            assert [(f["term"], f["tf"]) for f in g["found"]] == met


def test_word_characters_are_those_of_the_pattern(spark):
    chars = words.unpacked(words.word_chars(spark))
    blocks = [(at, "".join(chr(at + i) for i in range(64))) for at in (0, 128, 0x370, 0x4E00, 0x1D400, 0x1F600)]
    df = spark.createDataFrame(blocks, "at long, s string")
    for r in df.select("at", F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}_]"), F.lit(0)).alias("found")).collect():
        assert [ord(c) for c in r["found"]] == [r["at"] + i for i in range(64) if chars[r["at"] + i]]


def test_listed_words_are_counted_without_splitting_texts(spark, monkeypatch):
    def split(*_):
        raise AssertionError("texts are split")

    monkeypatch.setattr(bm, "tokens", split)
    docs = spark.createDataFrame([(1, "A b, a"), (2, None), (3, "c")], "doc_id long, text string")
    index = bm.bm25_index(docs, "doc_id", "text", listed=["a", "c"])
    got = {(r.doc_id, r.term): (r.doc_len, r.tf) for r in index.postings.collect()}
    assert got == {(1, ""): (3, 1), (1, "a"): (3, 2), (2, ""): (0, 1), (3, ""): (1, 1), (3, "c"): (1, 1)}
    assert {r.term: r.df for r in index.terms.collect()} == {"": 3, "a": 1, "c": 1}


def test_texts_of_columns_are_neither_moved_nor_sorted(spark):
    numbers = spark.range(50).select(F.col("id").alias("table_no"), F.lit("s").alias("subject"))
    tables = generate_tables(numbers.repartition(3))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = build_column_catalog(generate_columns(tables.repartition("table_name")), tables, 0)
        plan = rows.select("doc_id", "search_text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above and "Sort " not in above
    assert rows.count() == generate_columns(tables).count()
