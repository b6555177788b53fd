import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaquarry.operators import bm25 as bm
from metaquarry.operators.blocks import RunningTopK
from metaquarry.operators.context import search_schemas, search_sql_context
from metaquarry.operators.hybrid import Space, hybrid_search, without_text
from metaquarry.operators.knn import knn_approx, knn_exact, knn_within, recall
from metaquarry.operators.topk import top_k

random.seed(3)
WORDS = [f"w{i}" for i in range(30)]
# "the" is in most documents: a hot term
DOCS = [(i, " ".join(["the"] * (i % 3) + random.choices(WORDS, k=5 + i % 7)), f"p{i % 3}") for i in range(120)]
QUERIES = [(q, " ".join(["the", *random.choices(WORDS, k=3)])) for q in range(9)]


def brute_bm25(docs, queries, k, keep=lambda d: True):
    toks = {d: re.findall(r"\w+", text.lower()) for d, text, *_ in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    tf = {d: Counter(t) for d, t in toks.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for d, *_ in docs:
            s = 0.0
            for term in set(re.findall(r"\w+", text.lower())):
                if tf[d][term]:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    s += idf * tf[d][term] * 2.2 / (tf[d][term] + 1.2 * (0.25 + 0.75 * len(toks[d]) / avg))
            if s > 0 and keep(d):
                scores.append((-round(s, 4), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def ranked(df, ident="doc_id", score="sparse"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rk)):
        out.setdefault(r.query_id, []).append((r[ident], r[score]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, parent string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query_text string")


def test_bm25_equals_brute_force(docs, queries):
    assert ranked(bm.bm25_search(queries, docs, 4)) == brute_bm25(DOCS, QUERIES, 4)


def test_bm25_join_path_with_sliced_terms(docs, queries, monkeypatch):
    monkeypatch.setattr(bm, "SLICE_ROWS", 10)
    assert ranked(bm.bm25_search(queries, docs, 4, small_rows=0)) == brute_bm25(DOCS, QUERIES, 4)


def test_bm25_blocks_of_any_size(docs, queries, monkeypatch):
    monkeypatch.setattr(bm, "STEP_POSTINGS", 7)
    monkeypatch.setattr(bm, "BLOCK_CELLS", 20)
    assert ranked(bm.bm25_search(queries, docs, 4)) == brute_bm25(DOCS, QUERIES, 4)


@pytest.mark.parametrize("small_rows", [1000, 0])
def test_bm25_restricted_per_query(spark, docs, queries, small_rows):
    allowed = spark.createDataFrame([(q, f"p{q % 3}") for q in range(8)], "query_id long, parent string")
    got = ranked(bm.bm25_search(queries, docs, 4, allowed=allowed, parent="parent", small_rows=small_rows))
    for q, text in QUERIES[:8]:
        want = brute_bm25(DOCS, [(q, text)], 4, keep=lambda d: d % 3 == q % 3)[q]
        assert got.get(q, []) == want
    assert 8 not in got


def test_bm25_filter_keeps_collection_statistics(docs, queries):
    got = ranked(bm.bm25_search(queries, docs, 4, carried=("parent",), where=F.col("parent") == "p1"))
    assert got == {q: v for q, v in brute_bm25(DOCS, QUERIES, 4, keep=lambda d: d % 3 == 1).items() if v}


def test_bm25_saved_index(spark, docs, queries):
    path = tempfile.mkdtemp()
    bm.bm25_index(docs, "doc_id", "text", ("parent",)).save(path + "/ix")
    index = bm.Bm25Index.load(spark, path + "/ix", "doc_id", ("parent",))
    assert ranked(bm.bm25_search(queries, index, 4)) == brute_bm25(DOCS, QUERIES, 4)


def test_group_index_is_an_index_of_joined_texts(spark, docs, queries):
    whole = {}
    for _, text, parent in DOCS:
        whole[parent] = whole.get(parent, "") + " " + text
    got = ranked(bm.bm25_search(queries, bm.group_index(docs, "parent", "text"), 3), "parent")
    assert got == brute_bm25(list(whole.items()), QUERIES, 3)


def test_bm25_without_queries(spark, docs, queries):
    assert bm.bm25_search(queries.where("false"), docs, 3).count() == 0


RNG = np.random.default_rng(5)
VECS = RNG.standard_normal((90, 8)).astype(np.float32)
QVECS = RNG.standard_normal((11, 8)).astype(np.float32)


def brute_knn(qv, vv, k, keep=lambda q, v: True):
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(unit(qv) @ unit(vv).T, 6)
    out = {}
    for q in range(len(qv)):
        best = sorted((-s[q, v], v) for v in range(len(vv)) if keep(q, v))[:k]
        out[q] = [(v, -c) for c, v in best]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(x) for x in v], f"p{0 if i < 60 else i % 4}") for i, v in enumerate(VECS)]
    return spark.createDataFrame(rows, "doc_id long, dense_vector array<float>, parent string").repartition(3)


@pytest.fixture(scope="module")
def qvectors(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(QVECS)]
    return spark.createDataFrame(rows, "query_id long, query_vector array<float>")


def close(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x for x, _ in a[q]] == [x for x, _ in b[q]]
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]])


def test_knn_exact_paths_agree(qvectors, vectors, monkeypatch):
    import metaquarry.operators.knn as knn

    want = brute_knn(QVECS, VECS, 4)
    close(ranked(knn_exact(qvectors, vectors, 4), score="cosine"), want)
    close(ranked(knn_exact(qvectors, vectors, 4, ship=False, block_rows=7), score="cosine"), want)
    monkeypatch.setattr(knn, "SHIP_ROWS", 50)
    many = vectors.selectExpr("doc_id as query_id", "dense_vector as query_vector")
    few = qvectors.selectExpr("query_id as doc_id", "query_vector as dense_vector")
    close(ranked(knn_exact(many, few, 4), score="cosine"), brute_knn(VECS, QVECS, 4))


def test_knn_exclude_same(vectors):
    same = vectors.selectExpr("doc_id as query_id", "dense_vector as query_vector")
    want = brute_knn(VECS, VECS, 3, keep=lambda q, v: q != v)
    close(ranked(knn_exact(same, vectors, 3, exclude_same=True), score="cosine"), want)
    blocks = knn_exact(same, vectors, 3, exclude_same=True, ship=False, block_rows=20)
    close(ranked(blocks, score="cosine"), want)


def test_knn_within_hot_key(spark, qvectors, vectors):
    """Two thirds of the vectors share one key, which is split into blocks."""
    keys = spark.createDataFrame([(q, p) for q in range(11) for p in ("p0", "p1")], "query_id long, parent string")
    partial = knn_within(qvectors.join(keys, "query_id"), vectors, 3, "parent", block_rows=8)
    parent = lambda v: "p0" if v < 60 else f"p{v % 4}"
    want = brute_knn(QVECS, VECS, 3, keep=lambda q, v: parent(v) in ("p0", "p1"))
    close(ranked(top_k(partial, "query_id", "cosine", 3, "doc_id"), score="cosine"), want)


def test_knn_approx_finds_most(qvectors, vectors):
    found = knn_approx(qvectors, vectors, 4, dim=8, tables=16, bits=3, block_rows=16)
    truth = knn_exact(qvectors, vectors, 4)
    mean = recall(found, truth, "query_id", "doc_id").agg(F.avg("recall")).first()[0]
    assert mean > 0.9
    exact = dict((( q, d), s) for q, rows in ranked(truth, score="cosine").items() for d, s in rows)
    for r in found.collect():
        if (r.query_id, r.doc_id) in exact:
            assert abs(exact[(r.query_id, r.doc_id)] - r.cosine) < 1e-6


def test_hybrid_falls_back_to_plain_cosine(qvectors, vectors):
    space = Space(vectors, text_col="no_such_column")
    got = hybrid_search(qvectors.withColumn("query_text", F.lit("x")), space, 3)
    close(ranked(got, score="score"), brute_knn(QVECS, VECS, 3))
    assert without_text(space).text_col is None


def test_two_stage_fallback_only_for_unmet_queries(spark):
    parents = spark.createDataFrame(
        [("A", "apple tree", [1.0, 0.0]), ("B", "boat sea", [0.0, 1.0])],
        "doc_id string, search_text string, dense_vector array<float>",
    )
    children = spark.createDataFrame(
        [("a1", "A", "apple red", [1.0, 0.1]), ("a2", "A", "apple green", [0.9, 0.2])],
        "doc_id string, table_id string, search_text string, dense_vector array<float>",
    )
    queries = spark.createDataFrame(
        [(1, "apple", [1.0, 0.0]), (2, "boat", [0.0, 1.0])],
        "query_id long, query_text string, query_vector array<float>",
    )
    spaces = Space(parents), Space(children, parent_col="table_id")
    first, second = search_sql_context(queries, *spaces, parent_k=1, child_k=2)
    assert {(r.query_id, r.doc_id) for r in first.collect()} == {(1, "A"), (2, "B")}
    hits = {(r.query_id, r.doc_id, r.table_id) for r in second.collect()}
    # B has no column of its own: question 2 gets columns of any table
    assert hits == {(q, d, "A") for q in (1, 2) for d in ("a1", "a2")}
    nested = {r.query_id: (r.doc_id, len(r.children)) for r in search_schemas(queries, *spaces, 1).collect()}
    assert nested == {1: ("A", 2), 2: ("B", 0)}


def test_score_blocks_are_bounded(monkeypatch):
    import numpy as np

    from metaquarry.operators import knn
    from metaquarry.operators.blocks import RunningTopK

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(300, 8)), rng.normal(size=(2000, 8))
    ids, sizes = np.arange(2000), []
    plain = RunningTopK(300, 5)
    plain.add(knn._scores(np.arange(300), q, ids, v, True), ids)
    monkeypatch.setattr(knn, "STEP_CELLS", 10_000)
    scores = knn._scores
    monkeypatch.setattr(knn, "_scores", lambda *a: sizes.append(scores(*a)) or sizes[-1])
    stepped = RunningTopK(300, 5)
    knn._add_steps(stepped, np.arange(300), q, ids, v, True)
    assert max(s.size for s in sizes) <= 10_000
    names = (np.arange(300), "q", "v", "s")
    assert stepped.frame(*names).equals(plain.frame(*names))


def test_texts_are_read_twice_for_a_search(spark, docs, queries, monkeypatch):
    """Frequencies and lengths come from one pass, so only the scored words are read again; words
    no query asks for are dropped in their row, with the same hits as by a join."""
    seen = []
    index = bm.bm25_index
    monkeypatch.setattr(bm, "bm25_index", lambda *a, **k: seen.append(index(*a, **k)) or seen[-1])
    listed = ranked(bm.bm25_search(queries, docs, 5))
    assert listed == brute_bm25(DOCS, QUERIES, 5)
    for small in (seen[0].terms, seen[0].stats):
        assert "text" not in small._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(bm, "LISTED_TERMS", 1)
    assert ranked(bm.bm25_search(queries, docs, 5)) == listed


def test_md5_vectors_equal_their_buckets(spark):
    from metaquarry.models import hash_embedding, md5_bucket, word_buckets
    from metaquarry.functions.text import tokens

    texts = spark.createDataFrame([("a b a Ü_1 ,b",), ("",), (None,), ("--",), ("東京 a",)], "text string").coalesce(1)
    by_column = lambda term, dim: md5_bucket(term, dim)  # noqa: E731 - another function: the general way
    one, two = (texts.select(hash_embedding(F.col("text"), 16, "q: ", b).alias("v")).collect() for b in (md5_bucket, by_column))
    assert [r.v for r in one] == [r.v for r in two]
    words = tokens(F.coalesce(F.col("text"), F.lit("")))
    one, two = (texts.select(word_buckets(words, 16, b).alias("v")).collect() for b in (md5_bucket, by_column))
    assert [r.v for r in one] == [r.v for r in two]


def test_scores_of_bucket_pairs_are_bounded(monkeypatch):
    """No copy of both vectors of every pair: the peak stays near the size of the scores."""
    import tracemalloc

    from metaquarry.operators import knn

    rng = np.random.default_rng(2)
    q, v = rng.standard_normal((100, 64)), rng.standard_normal((4000, 64))
    monkeypatch.setattr(knn, "STEP_CELLS", 64_000)
    for share in (0.5, 0.01):
        met = rng.random((100, 4000)) < share
        tracemalloc.start()
        got = knn._met_scores(met, q, v)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * got.nbytes
        assert np.allclose(got[met], np.round(q @ v.T, knn.DENSE_DIGITS)[met]) and np.isneginf(got[~met]).all()


def test_listed_words_are_counted_in_one_pass_over_the_texts(spark, docs, queries, monkeypatch):
    seen = []
    index = bm.bm25_index
    monkeypatch.setattr(bm, "bm25_index", lambda *a, **k: seen.append(index(*a, **k)) or seen[-1])
    hits = bm.bm25_search(queries, docs, 5)
    assert "text" not in seen[0].postings._jdf.queryExecution().optimizedPlan().toString()
    assert ranked(hits) == brute_bm25(DOCS, QUERIES, 5)


def test_only_scores_among_the_best_are_rounded(monkeypatch):
    from metaquarry.operators import blocks

    rng = np.random.default_rng(2)
    scores = np.round(rng.random((4, 5000)), 3) + rng.choice([0, 4e-7, -4e-7], (4, 5000))  # ties once rounded
    scores[0, 7:] = -np.inf
    sizes, rounds = [], np.round
    monkeypatch.setattr(blocks.np, "round", lambda x, *a: sizes.append(np.size(x)) or rounds(x, *a))
    best = blocks.RunningTopK(4, 9)
    for at in range(0, 5000, 250):
        best.add(scores[:, at : at + 250], np.arange(at, at + 250))
    got = best.frame(np.arange(4), "q", "v", "s")
    monkeypatch.undo()
    assert sum(sizes) < scores.size / 4
    for q in range(4):
        want = sorted((-s, i) for i, s in enumerate(np.round(scores[q], 6)) if s > -np.inf)[:9]
        assert [(-r.s, r.v) for r in got[got.q == q].itertuples()] == want


def test_vectors_are_read_in_blocks_whatever_is_null(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, dense_vector array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, query_vector array<float>")
    found = knn_exact(asked, vectors, 5)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.cosine) for r in found.orderBy("rk").collect()] == [("a", 1.0), ("d", 0.707107), ("c", 0.0)]


def test_rows_are_spread_once(spark):
    from metaquarry.session import spread

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Repartition ")
    once = spread(spark.range(10).select("id", F.lit(3).alias("n")))
    many = once.select("id", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    assert plan(once) == plan(spread(many)) == 1
    assert plan(spread(many.join(spark.range(3).withColumnRenamed("id", "i"), "i"))) == 2


def test_only_rows_of_the_allowed_parents_are_encoded(spark, docs, queries, monkeypatch):
    from metaquarry.models import hash_embedding
    from metaquarry.operators import hybrid

    encode = lambda text: hash_embedding(text, 16)
    # as in a column catalog: the parent's name is known after a join only
    names = spark.createDataFrame([(f"p{i}", f"n{i}") for i in range(3)], "parent string, name string")
    named = docs.selectExpr("doc_id", "text AS search_text", "parent AS own").join(
        names, F.col("own") == F.col("parent"), "left"
    )
    rows = named.select("doc_id", "search_text", F.concat_ws("::", "name", "own").alias("of"))
    space = Space(rows.withColumn("dense_vector", encode(F.col("search_text"))), parent_col="of")
    asked = queries.withColumn("query_vector", encode(F.col("query_text")))
    allowed = asked.select("query_id", F.lit("n1::p1").alias("of"))
    seen, within = [], hybrid.knn_within
    monkeypatch.setattr(hybrid, "knn_within", lambda q, v, *a, **k: seen.append(v) or within(q, v, *a, **k))
    found = sorted(map(tuple, hybrid_search(asked, space, 3, allowed=allowed).collect()), key=str)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" in plan and plan.index("EvalPython") < plan.index("Filter") < plan.index("Join")
    assert found and {r[1] % 3 for r in found} == {1}
    monkeypatch.setattr(hybrid, "LISTED_PARENTS", 0)
    monkeypatch.setattr(bm, "LISTED_TERMS", 0)
    assert sorted(map(tuple, hybrid_search(asked, space, 3, allowed=allowed).collect()), key=str) == found


def test_groups_with_texts_without_words_are_encoded(spark):
    from metaquarry.models import group_hash_embedding, hash_embedding, md5_bucket

    # a text without words beside others, groups of such texts only, a group without a name
    texts = [("A", "a b a"), ("A", "--"), ("A", None), ("B", ""), ("C", None), (None, "c"), (None, "?!")]
    docs = spark.createDataFrame(texts, "source string, text string").coalesce(1)
    joined = docs.groupBy("source").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    for bucket in (md5_bucket, lambda term, dim: md5_bucket(term, dim)):
        got = group_hash_embedding(docs, "source", "text", 16, bucket).collect()
        want = joined.select("source", hash_embedding(F.col("text"), 16, "", bucket).alias("dense_vector")).collect()
        assert len(got) == 4 and {r.source: r.dense_vector for r in got} == {r.source: r.dense_vector for r in want}


def test_parents_without_an_id_are_ranked_last(spark):
    parents = spark.createDataFrame(
        [("A", "apple", [1.0, 0.0]), (None, "apple", [1.0, 0.0]), ("B", "boat", [0.0, 1.0])],
        "doc_id string, search_text string, dense_vector array<float>",
    ).coalesce(1)
    children = spark.createDataFrame(
        [(1, "A", "apple red", [1.0, 0.1]), (2, None, "apple", [1.0, 0.0])],
        "doc_id long, table_id string, search_text string, dense_vector array<float>",
    )
    queries = spark.createDataFrame(
        [(1, "apple", [1.0, 0.0])], "query_id long, query_text string, query_vector array<float>"
    )
    found = knn_exact(queries, parents.select("doc_id", "dense_vector"), 3)
    assert [r.doc_id for r in found.orderBy("rk").collect()] == ["A", None, "B"]
    first, second = search_sql_context(queries, Space(parents), Space(children, parent_col="table_id"), 3, 2)
    assert {r.doc_id for r in first.collect()} == {"A", None, "B"}
    assert [r.doc_id for r in second.collect()] == [1]


@pytest.mark.parametrize(
    "ids, want",
    [([3, None, 1, 2], [1, 2, 3, None]), (["b", None, "a", None], ["a", "b", None, None]), ([None, None], [None, None])],
)
def test_missing_ids_come_after_equal_scores(ids, want):
    best = RunningTopK(1, 4)
    for i in ids:
        best.add(np.ones((1, 1)), np.asarray([i]))
    got = best.frame(np.array([7]), "q", "id", "score")["id"].tolist()
    assert [None if x != x else x for x in got] == want
