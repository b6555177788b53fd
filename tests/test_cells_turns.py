"""Cell index, multi-probe buckets, task turns, catalog surface, positions under skew, paths."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaquarry import schemas as sc
from metaquarry.operators import cells, context as cx, hybrid, knn, memory as mm, turns
from metaquarry.operators.filters import catalog_filter
from metaquarry.operators.topk import top_k
from metaquarry.session import new_run_dir, ship_package


@pytest.fixture(scope="module")
def vectors(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 16)) * 3
    rows = [(i, [float(x) for x in middles[i % 12] + rng.standard_normal(16)], "a" if i % 3 else "b") for i in range(600)]
    rows += [(1000 + i, rows[5][1], "a") for i in range(300)]  # one vector with a third of all rows
    rows += [(2000, None, "a"), (2001, [0.0] * 16, "b")]
    return spark.createDataFrame(rows, "doc_id long, dense_vector array<float>, lang string").repartition(5)


@pytest.fixture(scope="module")
def asked(vectors):
    known = vectors.where("doc_id < 40").select(
        F.col("doc_id").alias("query_id"), F.col("dense_vector").alias("query_vector"), F.lit("x").alias("query_text")
    )
    none = F.lit(None).cast("array<float>")
    return known.unionByName(known.limit(1).withColumns({"query_id": F.lit(-1).cast("long"), "query_vector": none}))


@pytest.fixture(scope="module")
def index(spark, vectors):
    path = new_run_dir(spark, "cells-test")
    cells.CellIndex.save(vectors, path, cells=12)
    return cells.CellIndex.load(vectors, path)


def found(df):
    return sorted((r["query_id"], r["rk"], r["doc_id"], r["cosine"]) for r in df.collect())


def test_all_cells_give_the_exact_result(vectors, asked, index):
    assert index.rows.count() == 901  # all but the null vector
    exact = found(knn.knn_exact(asked, vectors, 5))
    for ship in (True, False):
        assert found(cells.knn_cells(asked, index, 5, probes=12, ship=ship)) == exact


def test_few_cells_find_most(vectors, asked, index):
    truth = knn.knn_exact(asked, vectors, 5)
    some = cells.knn_cells(asked, index, 5, probes=2)
    assert found(some) == found(cells.knn_cells(asked, index, 5, probes=2, ship=False))
    got = knn.recall(some, truth, "query_id", "doc_id").agg(F.avg("recall")).first()[0]
    assert got >= 0.9


def test_cells_prune_what_is_read(asked, index):
    plan = cells.knn_cells(asked, index, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    where = found(cells.knn_cells(asked, index, 900, probes=12, where=F.col("lang") == "b"))
    assert {d for _, _, d, _ in where} == {i for i in range(600) if i % 3 == 0} | {2001}


def test_empty_index(spark, vectors, asked):
    path = new_run_dir(spark, "cells-empty")
    cells.CellIndex.save(vectors.limit(0), path, cells=4)
    assert cells.knn_cells(asked, cells.CellIndex.load(vectors, path), 5, probes=2).count() == 0
    assert cells.CellIndex.load(vectors, path).rows.count() == 0


def test_index_is_saved_without_arrow_conversion(spark, vectors, asked, index):
    """Arrow conversion is off in a session that does not ask for it."""
    path, name = new_run_dir(spark, "cells-plain"), "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        cells.CellIndex.save(vectors, path, cells=12)
        plain = cells.CellIndex.load(vectors, path)
        assert (plain.centres == index.centres).all()
        assert found(cells.knn_cells(asked, plain, 5, probes=2)) == found(cells.knn_cells(asked, index, 5, probes=2))
    finally:
        spark.conf.set(name, before)


def test_space_with_vectors_of_its_own(vectors, asked, index):
    """Filters and approximate search agree with the exact search where all cells are read."""
    texts = vectors.select("doc_id", F.lit("x y").alias("search_text"), "lang")
    apart = hybrid.Space(texts, vectors=vectors, cells=index)
    joined = hybrid.Space(texts.drop("lang").join(vectors, "doc_id"))
    rows = [
        sorted(tuple(r) for r in hybrid.hybrid_search(asked, space, 4, filters={"lang": ["a"]}, **more).collect())
        for space, more in ((joined, {}), (apart, {}), (apart, {"exact_dense": False, "probes": 12}))
    ]
    assert rows[0] == rows[1] == rows[2] and rows[0]


@pytest.mark.parametrize("ship", [True, False])
def test_probes_by_distance(vectors, asked, ship):
    planes = knn.hyperplanes(16, 12)
    one = np.array([[1.0] * 16])
    own, probes = knn.bucket_keys(one, planes, 3), knn.probe_keys(one, planes, 3, 4)
    assert (probes[:, :, 0] == own).all() and len(set(probes.ravel().tolist())) == 15
    flips = [int(a ^ b).bit_length() - 1 for a, b in zip(probes[0, 0, 1:], [own[0, 0]] * 4)]
    far = np.abs((one * knn.GRID) @ planes[:4].T)[0] / np.linalg.norm(planes[:4], axis=1)
    assert flips == np.argsort(far).tolist()
    truth = knn.knn_exact(asked, vectors, 5, exclude_same=True)
    got = knn.knn_approx(asked, vectors, 5, dim=16, tables=8, bits=5, probes=2, exclude_same=True, ship=ship)
    recall = knn.recall(got, truth, "query_id", "doc_id").agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    assert found(got) == found(
        knn.knn_approx(asked, vectors, 5, dim=16, tables=8, bits=5, probes=2, exclude_same=True, ship=not ship)
    )


# --- catalog surface ------------------------------------------------------------------------


def test_questions_are_encoded_behind_the_instruction(spark):
    qs = spark.createDataFrame([(1, "sales")], "query_id long, query_text string")
    seen = []

    def encode(text, instruction=""):
        seen.append(instruction)
        return F.concat(F.lit(instruction), text)

    assert cx.ask(qs, encode).first()["query_vector"] == sc.QUERY_INSTRUCTION + "sales" and seen == [sc.QUERY_INSTRUCTION]


def test_unknown_filters_are_refused():
    with pytest.raises(TypeError):
        catalog_filter("template", dialect="x")


def test_hits_as_json(spark):
    hits = spark.createDataFrame([(1, '{"a": [1]}', "plain", None)], "n long, p string, q string, r string")
    row = hybrid.with_json(hits, ["n", "p", "q", "r", "nothing"])
    got = row.select("n", F.to_json("p"), F.to_json("q"), F.to_json("r")).first()
    assert tuple(got) == (1, '{"a":[1]}', '"plain"', None)


def test_conformance(spark):
    rows = spark.createDataFrame([("x" * 65, 1, None), ("y", 2, True)], "doc_id string, env long, is_active boolean")
    got = {r["field"]: r for r in sc.conformance(rows, sc.TABLES).collect()}
    assert len(got) == 31
    assert (got["doc_id"]["kind_fits"], got["doc_id"]["longest"], got["doc_id"]["n_over"]) == (True, 65, 1)
    assert (got["env"]["kind_fits"], got["env"]["longest"]) == (False, None)
    assert (got["is_active"]["n_null"], got["owner"]["is_there"], got["owner"]["n_null"]) == (1, False, None)


# --- task turns -----------------------------------------------------------------------------


def scripted(answers):
    def load():
        return lambda prompts: [answers[next(k for k in answers if k in p)] for p in prompts]

    return load


def test_task_turns(spark):
    ship_package(spark)
    slots = ["source_connection", "target_table"]
    templates = spark.createDataFrame(
        [(f"template::{c}", c, slots, f"load {c}", [1.0, float(i)], "ACTIVE", True) for i, c in enumerate(["t1", "t2"])],
        "doc_id string, template_code string, required_slots array<string>, search_text string, "
        "dense_vector array<float>, status string, is_active boolean",
    )
    qs = spark.createDataFrame(
        [(i, f"ask{i} load", [1.0, 0.0]) for i in (1, 2, 3, 4)], "query_id long, query_text string, query_vector array<float>"
    )
    state = spark.createDataFrame(
        [(2, "template::t2", "collecting", {"source_connection": "old", "x": "1"}), (3, "template::t2", "ready", {"x": "2"})],
        "query_id long, template_id string, status string, collected map<string,string>",
    )
    ready = {"task_json": {"name": "作业"}, "extracted_params": {"table": "t1"}, "missing_params": [], "explanation": "ok"}
    more = {"task_json": None, "extracted_params": {"source_connection": "new"}, "missing_params": ["target_table"], "explanation": "?"}
    answers = {"ask1": json.dumps(ready), "ask2": json.dumps(more), "ask3": "no", "ask4": json.dumps(more)}
    prompts, unmet = turns.task_prompts(qs, hybrid.Space(templates), state)
    text = {r["query_id"]: r["text"] for r in prompts.select("query_id", cx.render_prompt(F.col("prompt")).alias("text")).collect()}
    assert text[2].count("[Template") == 1 and "Code: t2" in text[2] and '"x":"1"' in text[2]
    assert text[1].count("[Template") == 2 and turns.KNOWN_LABEL not in text[1] and turns.KNOWN_LABEL in text[3]
    assert unmet.count() == 0
    got = {r["query_id"]: r for r in turns.task_replies(qs, hybrid.Space(templates), scripted(answers), state).collect()}
    assert {q: r["status"] for q, r in got.items()} == {1: "ready", 2: "collecting", 3: "error", 4: "collecting"}
    assert got[1]["collected"] == {"table": "t1"} and '"name": "作业"' in got[1]["final_output"]
    assert got[2]["template_id"] == "template::t2" and got[2]["collected"] == {"source_connection": "new", "x": "1"}
    assert "target_table" in got[2]["final_output"] and got[3]["collected"] == {"x": "2"}
    nothing = turns.task_replies(qs, hybrid.Space(templates.where("false")), scripted(answers), state).collect()
    assert {r["query_id"]: r["status"] for r in nothing} == {1: "no_hit", 2: "no_hit", 3: "no_hit", 4: "no_hit"} or {
        r["query_id"]: r["status"] for r in nothing
    } == {1: "no_hit", 3: "no_hit", 4: "no_hit"}


# --- positions and paths --------------------------------------------------------------------


def test_positions_with_one_hot_thread_in_one_second(spark):
    rows = spark.range(9_000).select(F.lit(1).cast("long").alias("thread"), F.lit(7).alias("second"), (9_000 - F.col("id")).alias("n"))
    rest = spark.range(1_000).select((F.col("id") % 50 + 2).alias("thread"), F.lit(7).alias("second"), F.col("id").alias("n"))
    none = spark.range(5).select(F.lit(None).cast("long").alias("thread"), F.lit(7).alias("second"), F.col("id").alias("n"))
    log = rows.unionByName(rest).unionByName(none).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        parts = mm.in_ranges(log, "thread", ["second", "n"]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r["count"] for r in parts) <= 5_000
    got = mm.positions(log, "thread", ["second", "n"]).toPandas()
    assert len(got) == 10_005
    for _, mine in got.groupby("thread", dropna=False):
        assert sorted(zip(mine["n"], mine["pos"])) == list(zip(sorted(mine["n"]), range(len(mine))))
    prev = mm.previous_value(log, "thread", "n", "n").toPandas()
    for _, mine in prev.groupby("thread", dropna=False):
        mine = mine.sort_values("n")
        assert mine["previous"].isna().tolist() == [True] + [False] * (len(mine) - 1)
        assert mine["previous"].tolist()[1:] == mine["n"].tolist()[:-1]
    assert mm.positions(log.where("false"), "thread", ["second", "n"]).count() == 0


def test_checkpoint_paths_with_branches_cycles_and_gaps(spark):
    links = [("a", i, i - 1 if i else None) for i in range(40)] + [("a", 100, 17), ("a", 101, 100)]
    links += [("b", 1, 3), ("b", 2, 1), ("b", 3, 2), ("c", 5, 4), ("c", 7, 7)]
    rows = [(t, c, p, f"s{c}") for t, c, p in links]
    history = spark.createDataFrame(rows, "thread_id string, checkpoint_id long, parent_id long, state string")
    history = mm.put_checkpoint(None, history.withColumn("ts", F.timestamp_seconds("checkpoint_id")))
    asked = [("a", 39), ("a", 101), ("b", 2), ("c", 5), ("c", 7), ("c", 9), ("a", 0)]
    starts = spark.createDataFrame(asked, "thread_id string, checkpoint_id long")
    parent = {(t, c): p for t, c, p in links}
    want = []
    for t, s in asked:
        at, seen = s, []
        while (t, at) in parent and at not in seen:
            seen.append(at)
            at = parent[t, at]
        want += [(t, s, d, c) for d, c in enumerate(seen)]
    got = mm.checkpoint_path(history, starts).collect()
    assert sorted((r["thread_id"], r["start_id"], r["depth"], r["checkpoint_id"]) for r in got) == sorted(want)


def test_top_k_is_stable(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (1, 2.0, 3)], "g long, s double, i long")
    assert [r["i"] for r in top_k(df, "g", "s", 1, "i").collect()] == [3]


# --- streams --------------------------------------------------------------------------------


def test_streams_go_on_from_a_table(spark):
    from metaquarry.streaming import jobs, state

    rows = [(t, i, "user", f"m{t}.{i}") for t in (1, 2, 3) for i in range(12)]
    log = spark.createDataFrame(rows, "thread_id long, turn long, role string, content string")
    base = new_run_dir(spark, "from-table")
    for part in ("turn between 4 and 7", "turn >= 8 and thread_id < 3"):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    start = state.thread_snapshot(log.where("turn < 4"), keep=5)
    jobs.run_to_batches(state.stream_thread_state(stream, keep=5, start=start), f"{base}/out", f"{base}/cp", "update")
    assert jobs.read_batches(spark, f"{base}/out").select("batch").distinct().count() == 2
    got = {r["thread_id"]: (r["n_messages"], r["turns"]) for r in jobs.read_current(spark, f"{base}/out", "thread_id").collect()}
    assert got == {1: (12, [7, 8, 9, 10, 11]), 2: (12, [7, 8, 9, 10, 11]), 3: (8, [3, 4, 5, 6, 7])}


def test_expired_and_living_threads(spark):
    from metaquarry.streaming import jobs, state

    log = spark.createDataFrame([(1, 0), (1, 5), (2, 8), (3, 100), (2, 101), (4, 300)], "thread_id long, s long")
    log = log.withColumn("at", F.timestamp_seconds(F.col("s") + 1_000))
    base = new_run_dir(spark, "expiry-test")
    for part in ("s < 10", "s between 10 and 200", "s > 200"):
        log.where(part).drop("s").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(log.drop("s").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.run_to_batches(state.stream_expired(stream, ttl_seconds=50), f"{base}/out", f"{base}/cp")
    gone = jobs.read_batches(spark, f"{base}/out").collect()
    assert sorted((r["thread_id"], r["n_messages"], r["last_us"]) for r in gone) == [(1, 2, 1_005_000_000)]
    living = state.living_threads(spark, f"{base}/cp").collect()
    assert sorted((r["thread_id"], r["n_messages"]) for r in living) == [(2, 2), (3, 1), (4, 1)]
