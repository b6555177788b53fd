"""The pipeline's stages, each against what its operator says about the stage's own input."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from metaquarry.llm import mixing, packing, secrets
from metaquarry.llm.common import stored
from tests.llm import edge
from tests.llm.test_join import brute

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect())


def test_stages_on_awkward_rows(spark):
    docs = edge.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        out.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = STAGES["language"](spark, docs, SF)
    assert kept.count() >= 0.99 * docs.count()  # all of these are clean
    bad = spark.createDataFrame([(10**6, "123 456 !!", "en", "a", 1), (10**6 + 1, None, "en", "a", 1)], edge.SCHEMA)
    assert STAGES["language"](spark, docs.unionByName(bad), SF).filter("doc_id >= 1000000").count() == 0


def test_near_duplicate_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if i == c}
    kept = STAGES["near_duplicates"](spark, docs, SF)
    assert rows(kept) == rows(docs.filter(edge.F.col("doc_id").isin(list(want))))
    again = STAGES["near_duplicates"](spark, edge.documents(spark), SF)
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, None: 2, 2**60 + 1: 1})


def test_secret_stage(spark):
    docs = edge.documents(spark)
    clean = STAGES["secrets"](spark, docs, SF)
    assert clean.count() == docs.count()
    for r in clean.collect():
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    left = secrets.find_secrets(clean, "doc_id", "text").filter("size(spans) > 0")
    assert left.count() == 0


def test_mixture_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    taken = mixing.mix_sources(docs, "doc_id", "text", "source").filter("size > 0").collect()
    want = Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in taken})
    got = Counter(r["doc_id"] for r in STAGES["mixture"](spark, docs, SF).collect())
    assert got == +want


def test_run(spark):
    """Every token of what the mixture kept is packed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
    out = corpus_pipeline.run(spark, SF)
    got, kept = out.collect(), docs.collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert all(re.fullmatch(r"src\d+", r["source"]) for r in got)
    # the sequences' ids, cut at the ends of text, are the texts again; a document that is taken
    # several times has pieces of each time
    pieces = {(r["doc_id"], r["doc_tokens"], r["start"]): np.frombuffer(r["ids"], "<u4") for r in got}
    encoding = packing.Encoder(packing.tokenizer_path()).encoding
    text = {}
    for doc, n in {(r["doc_id"], r["doc_tokens"]) for r in got}:
        parts, at = [], 0
        while at < n:
            parts.append(pieces[doc, n, at])
            at += len(parts[-1])
        ids = np.concatenate(parts)
        assert len(ids) == n and ids[-1] == packing.END_OF_TEXT
        text[doc] = encoding.decode(ids[:-1].tolist())
    assert text == {r["doc_id"]: r["text"] for r in kept}
