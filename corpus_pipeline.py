"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on the documents that the stage before it kept, written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.lang_crf import UNKNOWN, fit, held_out, identify
from metaquarry.llm.mixing import mix_sources
from metaquarry.llm.ngram_join import MAX_SHIPPED_IDS, jaccard_components
from metaquarry.llm.packing import pack, tokenizer_path
from metaquarry.llm.common import stored
from metaquarry.llm.secrets import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose likeliest language has a smaller share of its words is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or of unclear language go.

    The model learns from labelled documents that are not held out. Null and empty texts
    have no language and go; null ids, labels and sources stay.
    """
    docs = docs.select(*COLUMNS)
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(known, "doc_id", "text", "lang")
    found = identify(docs, "text", model)
    kept = (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= MIN_LANGUAGE_SCORE)
    return found.filter(kept).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Texts are sets of five-word shingles, linked at a Jaccard index of 0.8 or more. Every row
    is a document: different texts with the same id are kept apart, and of rows with the
    same id in a group the smallest in all columns stays. Rows with a null id, and
    documents without words, are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        kept = _first_rows(named)
    else:
        found = jaccard_components(docs, "doc_id", "text", 5, 80)
        first = stored(found.filter("component_id = doc_id").select("doc_id"), "first")
        few = first.count() <= MAX_SHIPPED_IDS
        kept = docs.join(F.broadcast(first) if few else first, "doc_id").select(*COLUMNS)
    return kept.unionByName(docs.filter("doc_id is null"))


def _first_rows(docs: DataFrame) -> DataFrame:
    """The smallest row of each group, of a table whose ids repeat."""
    rows = stored(docs.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows, "row_id", "text", 5, 80).select(F.col("doc_id").alias("row_id"), "component_id")
    row = F.struct(*COLUMNS)
    first = rows.join(found, "row_id").groupBy("component_id").agg(F.min(row).alias("row"))
    return first.select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of their secrets replaced.

    Null and empty texts stay as they are, and so does everything around a secret in texts of
    any length. Repeated rows stay, columns besides those of documents are ignored, and an empty
    table gives no rows.
    """
    clean = redact_secrets(docs.select(*COLUMNS), "text")
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole: 0 to 3 times.

    A document is taken when half of its words or more are; documents without words, null and
    empty ones among them, are not. Repeated rows are taken each on its own, null ids and sources
    count, columns besides those of documents are ignored, and an empty table gives no rows.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    mixed = mix_sources(rows, "row_id", "text", "source", order_col="doc_id")
    times = mixed.filter("size > 0").select(
        F.col("doc_id").alias("row_id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")
    )
    times = stored(times.filter("times > 0"), "times")
    few = times.count() <= MAX_SHIPPED_IDS
    return (
        rows.join(F.broadcast(times) if few else times, "row_id")
        .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*COLUMNS)
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of at most 2048, each window of the sources' mixture, with
    the ids of every piece: ``ids`` in the order of sequence_id and offset is what to train on.

    Null and empty texts are an end of text alone, of whatever length texts are; repeated rows
    are packed each, and columns besides those of documents are ignored. Without rows there are
    no pieces.
    """
    return pack(docs.select(*COLUMNS), "doc_id", "text", "source", tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: SQL has no conditional random field and no tokenizer; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
