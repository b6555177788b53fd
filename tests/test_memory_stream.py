import glob
import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from metaquarry.operators import memory as mm
from metaquarry.streaming import jobs
from metaquarry.streaming.state import stream_slot_fill, stream_thread_state

# thread 1 holds most of the messages
SIZES = {1: 90, 2: 5, 3: 1}


@pytest.fixture(scope="module")
def log(spark):
    rows = [(t, i, "user" if i % 2 == 0 else "assistant", f"m{t}.{i}") for t, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "thread_id long, turn long, role string, content string").repartition(4)


@pytest.mark.parametrize("chunk", [1, 13, 4096])
@pytest.mark.parametrize("n", [3, 12, 0])
def test_history(log, monkeypatch, chunk, n):
    monkeypatch.setattr(mm, "CHUNK_ROWS", chunk)
    rows = mm.history_and_input(log, "thread_id", "turn", "role", "content", n).collect()
    assert len(rows) == sum(SIZES.values())
    for r in rows:
        low = max(0, r.turn - n) if n > 0 else 0
        assert [h.content for h in r.history] == [f"m{r.thread_id}.{i}" for i in range(low, r.turn)]
        assert r.input == f"m{r.thread_id}.{r.turn}"


@pytest.mark.parametrize("chunk", [10, 4096])
def test_summary_due(log, monkeypatch, chunk):
    monkeypatch.setattr(mm, "CHUNK_ROWS", chunk)
    rows = mm.summary_due(log, "thread_id", "turn", "turn").collect()
    assert sorted(r.n_messages for r in rows) == list(range(24, 91))
    for r in rows:
        assert r.window == list(range(r.turn - 23, r.turn + 1))


def test_positions_and_previous_by_bucket(log):
    bucket = F.floor(F.col("turn") / 7)
    sparse = log.where("turn % 5 <> 3")
    rows = mm.positions(sparse, "thread_id", ["turn"], bucket).collect()
    for t in SIZES:
        turns = sorted((r.turn, r.pos) for r in rows if r.thread_id == t)
        assert [p for _, p in turns] == list(range(len(turns)))
    prev = mm.previous_value(sparse, "thread_id", "turn", "turn", bucket, "before").collect()
    mine = sorted((r.turn, r.before) for r in prev if r.thread_id == 1)
    assert [b for _, b in mine] == [None] + [t for t, _ in mine[:-1]]


def test_checkpoints_expire_and_latest_is_last_written(spark):
    rows = spark.sql(
        """select * from values (1L, 9L, null, timestamp_ntz'2024-01-01 00:00:00', 'a'),
          (1L, 5L, 9L, timestamp_ntz'2024-01-03 00:00:00', 'b'), (2L, 1L, null, timestamp_ntz'2023-12-01 00:00:00', 'c')
          as t(thread_id, checkpoint_id, parent_id, ts, state)"""
    )
    history = mm.put_checkpoint(None, rows)

    def at(day):
        got = mm.latest_checkpoint(history, F.expr(f"timestamp_ntz'2024-01-{day} 00:00:00'"))
        return {r.thread_id: r.checkpoint_id for r in got.collect()}

    assert at("02") == {1: 9}
    assert at("04") == {1: 5}
    assert at("09") == {1: 5}
    assert at("10") == {}
    parents = {r.checkpoint_id: r.parent_state for r in mm.checkpoint_parent(history).collect()}
    assert parents[5] == "a" and parents[9] is None
    ids = spark.sql("select 1L thread_id, 9L checkpoint_id union all select 1, 77")
    got = mm.latest_checkpoint(history, F.expr("timestamp_ntz'2024-01-04 00:00:00'"), ids).collect()
    assert [(r.checkpoint_id, r.state) for r in got] == [(9, "a")]


def test_assign_thread(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "thread_id string")
    out = mm.assign_thread(df).collect()
    ids = [r.thread_id for r in out]
    assert ids[0] == "a" and len(set(ids)) == 3 and all(len(i) == 36 for i in ids[1:])
    assert [r.is_new for r in out] == [False, True, True]


def as_stream(spark, df, files=4):
    """A stream that takes one file per batch, in no useful order."""
    path = tempfile.mkdtemp()
    df.repartition(files).write.parquet(path + "/in")
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path + "/in"), path


def test_thread_stream_equals_batch(spark, log):
    stream, path = as_stream(spark, log)
    jobs.run_to_batches(stream_thread_state(stream), path + "/out", path + "/cp", "update")
    got = {r.thread_id: r for r in jobs.read_current(spark, path + "/out", "thread_id", "n_messages").collect()}
    assert {t: r.n_messages for t, r in got.items()} == SIZES
    assert got[1].turns == list(range(66, 90)) and got[1].contents[-1] == "m1.89"
    assert got[3].contents == ["m3.0"]


def test_slot_stream_equals_batch(spark, log):
    params = log.select(
        "thread_id", F.concat(F.lit("s"), F.col("turn") % 4).alias("slot"), F.col("content").alias("value"),
        F.floor(F.col("turn") / 2).alias("at"), F.col("turn").alias("seq"),
    )
    from metaquarry.operators.slots import latest_params

    want = {r.thread_id: r.collected for r in latest_params(params, "thread_id", "slot", "value", ["at", "seq"]).collect()}
    stream, path = as_stream(spark, params)
    jobs.run_to_batches(stream_slot_fill(stream), path + "/out", path + "/cp", "update")
    got = {r.thread_id: r.collected for r in jobs.read_current(spark, path + "/out", "thread_id").collect()}
    assert got == want


def test_slots_are_one_value_of_the_state():
    """A batch reads and writes a thread's state once, however many slots it has."""
    import pandas as pd

    from metaquarry.streaming.state import SlotValues

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    slots = SlotValues(1000)
    held = slots.values = Held()
    rows = [(f"s{i % 9}", f"v{i}", i // 2, i) for i in range(40)]
    for part in (rows[20:], rows[:20]):
        held.calls = 0
        got = list(slots.handleInputRows((7,), iter([pd.DataFrame(part, columns=["slot", "value", "at", "seq"])]), None))
        assert held.calls == 2
    want = {s: v for s, v, _, _ in rows}  # the last of every slot
    assert dict(zip(got[0]["slots"][0], got[0]["vals"][0])) == want


def test_state_expires(spark, log):
    """With a very short time to live, a later batch starts from nothing."""
    path = tempfile.mkdtemp()
    log.where("thread_id = 2 and turn < 3").coalesce(1).write.parquet(path + "/in/a")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(path + "/in")
    job = lambda: jobs.run_to_batches(stream_thread_state(stream, ttl_seconds=1), path + "/out", path + "/cp", "update")
    job()
    time.sleep(3)
    log.where("thread_id = 2 and turn >= 3").coalesce(1).write.parquet(path + "/in/b")
    job()
    counts = [r.n_messages for r in jobs.read_batches(spark, path + "/out").orderBy("batch").collect()]
    assert counts == [3, 2]


def test_stream_upsert_and_compact(spark, log):
    stream, path = as_stream(spark, log)
    jobs.stream_upsert(stream, path + "/out", path + "/cp", "thread_id", "turn")
    newest = {r.thread_id: r.turn for r in jobs.read_current(spark, path + "/out", "thread_id", "turn").collect()}
    assert newest == {t: n - 1 for t, n in SIZES.items()}
    jobs.compact(spark, path + "/out", path + "/folded", "thread_id", "turn")
    assert jobs.read_current(spark, path + "/folded", "thread_id").count() == len(SIZES)


def test_guard_stream(spark):
    df = spark.createDataFrame([("SELECT 1", True, "e"), ("DROP TABLE x", True, "e")], "sql string, is_safe boolean, explanation string")
    stream, path = as_stream(spark, df, 2)
    jobs.run_to_batches(jobs.stream_guard(stream), path + "/out", path + "/cp")
    assert sorted(r.blocked for r in jobs.read_batches(spark, path + "/out").collect()) == [False, True]


def test_even_buckets_split_a_hot_thread(log):
    bucket = mm.even_buckets(log, F.col("turn"), rows_per_bucket=20)
    rows = mm.positions(log, "thread_id", ["turn"], bucket).collect()
    assert all(r.pos == r.turn for r in rows)
    sizes = log.where("thread_id = 1").groupBy(bucket.alias("b")).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) <= 20
    assert log.where("false").select(mm.even_buckets(log.where("false"), F.col("turn"))).count() == 0


def test_model_summary_keeps_the_previous_one_on_failure(spark):
    from metaquarry.operators.memory import summarize

    log = spark.createDataFrame(
        [(t, i, f"m{i}") for t in (1, 2, 3) for i in range(4 if t < 3 else 2)], "thread long, pos long, text string"
    )
    old = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "thread long, summary string")
    made = summarize(
        log.withColumn("text", F.when(F.col("thread") == 2, "").otherwise(F.col("text"))),
        log.select("thread", "pos", F.lit("x").alias("term")),
        "thread",
        "pos",
        "text",
        trigger=3,
        window=2,
        previous=old,
        model=lambda text: F.when(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))) != "", F.upper(text)),
    )
    assert {r.thread: r.summary for r in made.collect()} == {1: "M2\nM3", 2: "old", 3: "old"}


def test_tables_are_streamed_from_a_file_or_a_folder(spark, log):
    """A table of several files is a folder; one file may carry the table's name itself."""
    from metaquarry.plans.registry import Tables
    from metaquarry.plans.streams import streams

    path = tempfile.mkdtemp()
    log.repartition(3).write.parquet(path + "/folder.parquet")
    log.coalesce(1).write.parquet(path + "/one")
    (part,) = glob.glob(path + "/one/*.parquet")
    shutil.copy(part, path + "/file.parquet")
    for name in ("folder", "file"):
        rows = getattr(streams(Tables(spark, path)), name)
        jobs.run_to_batches(rows, f"{path}/out-{name}", f"{path}/cp-{name}")
        assert jobs.read_batches(spark, f"{path}/out-{name}").count() == sum(SIZES.values())
