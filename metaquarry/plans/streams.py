"""Registered streaming jobs: each reads a table as a stream, runs to its end and returns
what it wrote. Outputs and checkpoints go to the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.operators import slots as sl
from metaquarry.plans import sqlparts as sp
from metaquarry.plans import statements as st
from metaquarry.plans import tasks as tk
from metaquarry.plans.registry import Tables, query
from metaquarry.session import cut_lineage, new_run_dir
from metaquarry.sources.buckets import BucketTable, stream_into
from metaquarry.streaming.jobs import read_batches, read_current, run_to_batches, stream_guard, stream_upsert
from metaquarry.streaming.state import (
    living_threads,
    slot_snapshot,
    stream_expired,
    stream_slot_fill,
    stream_thread_state,
    thread_snapshot,
)


class Streams(Tables):
    """``s.events`` is the events table as a stream; the table is one file or a folder of files."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        # a stream takes a single file only where its path is a pattern
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def streams(t) -> Streams:
    return Streams(t.spark, t.sf_dir)


def _files(rows, t, label: str, n: int = 4):
    """The rows as a stream of ``n`` files, one for each micro-batch."""
    path = new_run_dir(t.spark, label)
    rows.repartition(n).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, t, label, mode="append"):
    base = new_run_dir(t.spark, label)
    run_to_batches(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return f"{base}/out"


@query(
    "k1_stream_thread_state",
    """SELECT conv_id AS thread_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS win
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
      WHERE n <= 24 GROUP BY 1""",
)
def k1(t):
    messages = streams(t).conversations.select(
        F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content")
    )
    out = _run(stream_thread_state(messages), t, "thread-state", "update")
    lines = F.zip_with("roles", "contents", lambda r, c: F.concat(r, F.lit(": "), c))
    current = read_current(t.spark, out, "thread_id", "n_messages")
    return current.select("thread_id", "n_messages", F.array_join(lines, "\n").alias("win"))


@query(
    "k1_stream_from_table",
    """SELECT conv_id AS thread_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS win
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
      WHERE n <= 24 GROUP BY 1""",
)
def k1_start(t):
    """The first half of every conversation is a table, the rest comes in several micro-batches."""
    messages = t.conversations.select(F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content"))
    start = cut_lineage(thread_snapshot(messages.where("turn < 3")))
    stream = _files(messages.where("turn >= 3"), t, "messages")
    out = _run(stream_thread_state(stream, start=start), t, "thread-state", "update")
    current = read_current(t.spark, out, "thread_id", "n_messages")
    still = start.join(current.select("thread_id"), "thread_id", "left_anti")
    lines = F.zip_with("roles", "contents", lambda r, c: F.concat(r, F.lit(": "), c))
    return current.unionByName(still).select("thread_id", "n_messages", F.array_join(lines, "\n").alias("win"))


@query(
    "k2_stream_slot_fill",
    sp.with_(
        tk.LOG,
        tk.REQUIRED,
        tk.NEEDS,
        tk.MISSING,
        select="""SELECT thread_id, string_agg(slot || '=' || value, ';' ORDER BY slot) AS params, missing
          FROM latest JOIN missing_list USING (thread_id) GROUP BY ALL""",
    ),
)
def k2(t):
    log = tk.slot_log(streams(t))
    at = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col("ts"))
    params = log.select("thread_id", "slot", "value", at.alias("at"), F.col("event_id").alias("seq"))
    filled = stream_slot_fill(params)
    out = _run(filled, t, "slot-fill", "update")
    state = read_current(t.spark, out, "thread_id")
    code = F.element_at(
        F.array(*[F.lit(r["template_code"]) for r in tk.RULES]), (F.pmod("thread_id", F.lit(3)) + 1).cast("int")
    )
    state = state.withColumn("template_code", code).join(F.broadcast(tk.templates(t.spark)), "template_code")
    missing = sl.missing_params(F.col("required_slots"), F.col("collected"), F.col("compatibility_rules"))
    return state.select(
        "thread_id", tk.entries(F.col("collected")).alias("params"), F.array_join(missing, ",").alias("missing")
    )


@query(
    "k2_stream_from_table",
    sp.with_(
        tk.LOG,
        tk.REQUIRED,
        tk.NEEDS,
        tk.MISSING,
        select="""SELECT thread_id, string_agg(slot || '=' || value, ';' ORDER BY slot) AS params
          FROM latest GROUP BY ALL""",
    ),
)
def k2_start(t):
    """Values of even events are a table, those of odd ones a stream, in any order of time."""
    at = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col("ts"))
    params = tk.slot_log(t).select("thread_id", "slot", "value", at.alias("at"), F.col("event_id").alias("seq"))
    start = cut_lineage(slot_snapshot(params.where("seq % 2 = 0")))
    out = _run(stream_slot_fill(_files(params.where("seq % 2 = 1"), t, "params"), start=start), t, "slot-fill", "update")
    current = read_current(t.spark, out, "thread_id")
    still = start.join(current.select("thread_id"), "thread_id", "left_anti")
    state = current.unionByName(still.select("thread_id", F.map_from_arrays("slots", "vals").alias("collected")))
    return state.select("thread_id", tk.entries(F.col("collected")).alias("params"))


EXPIRY_SECONDS = 2 * 24 * 3600


@query(
    "k3_state_expiry",
    f"""WITH log AS (SELECT user_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1
        ELSE 2 END AS part FROM events),
      kept AS (SELECT * FROM log WHERE user_id % 5 > part OR user_id % 5 = 0)
      SELECT user_id AS thread_id, count(*) AS n_messages, max(ts) AS last_at, max(part) < 2 AND
        max(ts) + INTERVAL {EXPIRY_SECONDS} SECOND <= (SELECT max(ts) FROM kept WHERE part < 2) AS expired
      FROM kept GROUP BY 1""",
)
def k3(t):
    """Users fall silent after a third or two thirds of the time; who is given up, and who lives?"""
    part = F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 0).when(
        F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), 1
    )
    log = t.events.select("user_id", "ts", F.coalesce(part, F.lit(2)).alias("part"))
    kept = log.where("user_id % 5 > part or user_id % 5 = 0")
    kept = kept.select(F.col("user_id").alias("thread_id"), F.col("ts").cast("timestamp").alias("at"), "part")
    base = new_run_dir(t.spark, "expiry")
    for i in range(3):  # the thirds of the time come one after another, each in as many files as it has tasks
        kept.where(f"part = {i}").drop("part").write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(kept.drop("part").schema).parquet(f"{base}/in")
        run_to_batches(stream_expired(stream, EXPIRY_SECONDS), f"{base}/out", f"{base}/checkpoint")
    gone = read_batches(t.spark, f"{base}/out").drop("batch").withColumn("expired", F.lit(True))
    living = living_threads(t.spark, f"{base}/checkpoint").withColumn("expired", F.lit(False))
    last = F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_at")
    return gone.unionByName(living).select("thread_id", "n_messages", last, "expired")


@query(
    "k4_stream_upsert",
    """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type
      FROM events GROUP BY 1""",
)
def k4(t):
    base = new_run_dir(t.spark, "upsert")
    updates = streams(t).events.select("user_id", "event_id", "event_type")
    stream_upsert(updates, f"{base}/out", f"{base}/checkpoint", "user_id", "event_id")
    return read_current(t.spark, f"{base}/out", "user_id", "event_id")


@query(
    "k4_stream_buckets",
    """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type
      FROM events GROUP BY 1""",
)
def k4_buckets(t):
    """Early events are a table of buckets, later ones are upserted batch by batch."""
    base = new_run_dir(t.spark, "stream-buckets")
    events = t.events.select("user_id", "event_id", "event_type")
    newest = F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e")
    early = events.where("event_id % 10 < 3").groupBy("user_id").agg(newest).select("user_id", "e.*")
    table = BucketTable.create(early, f"{base}/table", "user_id", "event_id", buckets=16)
    stream_into(_files(events.where("event_id % 10 >= 3"), t, "updates", 3), table, f"{base}/checkpoint")
    return table.read()


@query(
    "k5_stream_guard",
    st._guard_sql(f"array_to_string({st.REASONS}, ',') AS reasons, {st.SAFE} AS safe_sql"),
)
def k5(t):
    out = _run(stream_guard(st.statements(streams(t))), t, "guard")
    rows = read_batches(t.spark, out)
    return rows.select("conv_id", "turn", F.array_join("block_reasons", ",").alias("reasons"), "safe_sql")
