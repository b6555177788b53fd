"""The plans Spark makes are the ones the operators are written for."""

import os

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(spark, name, run=False):
    df = entry_point.queries()[name](spark, SF)
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    for name in ("e03_bm25_search", "e06_top_k", "j7_list_checkpoints"):
        text = plan(spark, name)
        assert "WindowGroupLimit" in text, name
        # the partial limit is below the exchange
        assert text.index("Partial") > text.index("Exchange hashpartitioning"), name


def test_filters_reach_the_scan(spark):
    text = plan(spark, "a6_lookup")
    assert "In(lang, [de,en])" in text or "In(lang, [en,de])" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in text


def test_postings_are_not_shuffled(spark):
    text = plan(spark, "e03_bm25_search")
    assert "hashpartitioning(doc_id" not in text
    # counts by term and the best k per query are all that moves
    assert "hashpartitioning(term" in text and "hashpartitioning(query_id" in text


def test_saved_index_prunes_term_directories(spark, tmp_path):
    from metaquarry.operators.bm25 import Bm25Index, bm25_index, bm25_search

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bm25_index(docs, "doc_id", "text").save(str(tmp_path / "ix"))
    index = Bm25Index.load(spark, str(tmp_path / "ix"), "doc_id")
    queries = spark.sql("select 1L query_id, 'the' query_text")
    found = bm25_search(queries, index, 3)
    assert found.count() == 3
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_part" in text or "PartitionFilters: [(term_part" in text
