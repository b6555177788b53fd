"""Conversation memory: history windows, summaries, checkpoints, turn responses.

A thread may hold a large share of all messages, so no window runs over a whole thread:
messages are numbered within sampled ranges plus the sizes of earlier ranges, and framed
windows run over chunks of consecutive messages that overlap by the frame length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.operators.context import ordered_join
from metaquarry.operators.parsing import NOT_UNDERSTOOD
from metaquarry.operators.topk import top_k
from metaquarry.schemas import (
    HISTORY_MESSAGES,
    STATE_TTL_SECONDS,
    SUMMARY_TRIGGER,
    SUMMARY_WINDOW,
)
from metaquarry.session import cut_lineage

CHUNK_ROWS = 4096
BUCKET_ROWS = 2_000_000


def append_messages(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new)


def latest_fields(updates: DataFrame, thread: str, order: list[str], fields: list[str]) -> DataFrame:
    """Overwrite semantics: the last non-null value of each field per thread."""
    key = F.struct(*order)
    aggs = [
        F.max_by(f, F.when(F.col(f).isNotNull(), key)).alias(f) for f in fields
    ]
    return updates.groupBy(thread).agg(*aggs)


def even_buckets(log: DataFrame, order: Column, rows_per_bucket: int = BUCKET_ROWS) -> Column:
    """A bucket number that does not decrease along ``order`` (a whole number, such as
    seconds): equal ranges, as many as make ``rows_per_bucket`` rows each on average.

    The rows of all threads together fill a bucket, so a thread holding most of them is cut
    into nearly as many parts as there are buckets.
    """
    n, low, high = log.agg(F.count(order), F.min(order), F.max(order)).first()
    if not n:
        return F.lit(0)
    buckets = -(-n // rows_per_bucket)
    width = max(1, -(-(high - low + 1) // buckets))
    return F.floor((order - F.lit(low)) / F.lit(width))


def in_ranges(log: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """The log in sampled ranges of (thread, order), stored; adds ``_part`` and ``_row``.

    Ranges hold about the same number of rows whatever the threads' sizes and however close
    their messages lie in time, so a thread with most of the rows spans most of the ranges.
    ``_part`` does not decrease along a thread, and ``_row`` numbers the rows of a range. The
    order must tell a thread's rows apart: rows equal in it stay in one range.
    """
    ranged = log.repartitionByRange(thread, *order).sortWithinPartitions(thread, *order)
    number = F.monotonically_increasing_id()  # the range above 33 bits, the row in it below
    return cut_lineage(ranged.withColumn("_id", number)).select(
        "*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")
    ).drop("_id")


def _in_parts(log: DataFrame, thread: str, order: list[str], bucket: Column | None) -> DataFrame:
    if bucket is None:
        return in_ranges(log, thread, order)
    within = Window.partitionBy(thread, "_part").orderBy(*order)
    return log.withColumn("_part", bucket).withColumn("_row", F.row_number().over(within))


def positions(log: DataFrame, thread: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """Add ``pos``, 0 for a thread's first message; a null thread is a thread.

    Rows are numbered within ranges (``in_ranges``), or within buckets that must not decrease
    along the order, such as stored days; only the sizes of (thread, range) are summed along
    the thread.
    """
    rows = _in_parts(log, thread, order, bucket)
    sizes = rows.groupBy(thread, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(thread).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = sizes.select(F.col(thread).alias("_thread"), F.col("_part").alias("_own"), offset.alias("_off"))
    same = rows[thread].eqNullSafe(F.col("_thread")) & (rows["_part"] == F.col("_own"))
    numbered = rows.join(offsets, same).withColumn("pos", F.col("_row") + F.col("_off"))
    return numbered.drop("_part", "_row", "_thread", "_own", "_off")


def previous_value(
    log: DataFrame, thread: str, order: str, value: str, bucket: Column | None = None, name: str = "previous"
) -> DataFrame:
    """Add the value of the thread's preceding row, as ``lag`` would, range by range."""
    rows = _in_parts(log, thread, [order], bucket)
    last = rows.groupBy(thread, "_part").agg(F.max_by(value, "_row").alias("_last"))
    by_part = Window.partitionBy(thread).orderBy("_part")
    carried = last.select(
        F.col(thread).alias("_thread"), F.col("_part").alias("_own"), F.lag("_last").over(by_part).alias("_carried")
    )
    within = Window.partitionBy(thread, "_part").orderBy("_row")
    inside = rows.withColumns({"_inside": F.lag(value).over(within), "_at": F.row_number().over(within)})
    same = inside[thread].eqNullSafe(F.col("_thread")) & (inside["_part"] == F.col("_own"))
    joined = inside.join(carried, same)
    found = joined.withColumn(name, F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_inside")))
    return found.drop("_part", "_row", "_thread", "_own", "_carried", "_inside", "_at")


def framed(
    log: DataFrame, thread: str, pos: str, before: int, last: int, name: str, value: Column
) -> DataFrame:
    """Add an array of ``value`` over the rows from ``before`` preceding to ``last``.

    ``pos`` numbers a thread's rows without gaps. A chunk also receives the ``before``
    rows ahead of it, so every frame is complete within its chunk.
    """
    size = max(CHUNK_ROWS, before)
    chunk = F.floor(F.col(pos) / size)
    in_tail = F.pmod(F.col(pos), F.lit(size)) >= size - before
    places = F.when(in_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = log.withColumn("_chunk", F.explode(places))
    w = Window.partitionBy(thread, "_chunk").orderBy(pos).rowsBetween(-before, last)
    return (
        spread.withColumn(name, F.collect_list(value).over(w))
        .where(F.col("_chunk") == chunk)
        .drop("_chunk")
    )


def history_and_input(
    log: DataFrame,
    thread: str,
    pos: str,
    role: str,
    text: str,
    n: int = HISTORY_MESSAGES,
) -> DataFrame:
    """For every message as the current one: ``history`` (at most n messages before it, as
    role and content) and ``input``. n <= 0 keeps all: such arrays grow with the square of the
    thread, so it is meant for threads of known length."""
    item = F.struct(F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    if n > 0:
        out = framed(log, thread, pos, n, -1, "history", item)
    else:
        w = Window.partitionBy(thread).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        out = log.withColumn("history", F.collect_list(item).over(w))
    return out.withColumn("input", F.coalesce(F.col(text), F.lit("")))


def summary_due(
    log: DataFrame,
    thread: str,
    pos: str,
    value: str,
    trigger: int = SUMMARY_TRIGGER,
    window: int = SUMMARY_WINDOW,
) -> DataFrame:
    """Messages at which a summary is due (every one from the trigger-th on), each with the
    last ``window`` values, its own included."""
    out = framed(log, thread, pos, window - 1, 0, "window", F.col(value))
    return out.where(F.col(pos) + 1 >= trigger).withColumn("n_messages", F.col(pos) + 1)


def summarize(
    log: DataFrame,
    tokens: DataFrame,
    thread: str,
    pos: str,
    text: str,
    *,
    m: int = 3,
    trigger: int = SUMMARY_TRIGGER,
    window: int = SUMMARY_WINDOW,
    previous: DataFrame | None = None,
    salts: int = 16,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Extractive summary per thread: of its last ``window`` messages, the m with the
    rarest words (highest mean idf over distinct tokens), in order. A thread below the
    trigger keeps its previous summary.

    ``tokens`` has one row per token: thread, pos, term. Word frequencies cover the whole
    log; only the words of the last windows are scored. Weights are joined to them on
    (term, salt), so a very frequent term is spread over ``salts`` tasks.

    With ``model``, a function of the window's text, its output is the summary; where it
    is null or empty the previous summary stays.
    """
    size = log.groupBy(thread).agg((F.max(pos) + 1).alias("_size"))
    recent = log.join(size, thread).where(
        (F.col("_size") >= trigger) & (F.col(pos) >= F.col("_size") - window)
    )
    if model is not None:
        made = recent.groupBy(thread).agg(ordered_join(pos, text, "\n").alias("_text"))
        made = made.select(thread, F.nullif(model(F.col("_text")), F.lit("")).alias("_new"))
        return _with_previous(size, made, previous, thread)
    words = tokens.select(thread, pos, "term").distinct()
    n = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = idf.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = idf.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = words.join(recent.select(thread, pos), [thread, pos], "left_semi")
    salted = near.withColumn("_s", F.pmod(F.xxhash64(thread, pos), F.lit(salts)).cast("int"))
    scores = (
        salted.join(idf, ["term", "_s"])
        .groupBy(thread, pos)
        .agg(F.round(F.avg("idf"), 4).alias("_score"))
    )
    scored = recent.join(scores, [thread, pos], "left").withColumn(
        "_score", F.coalesce("_score", F.lit(0.0))
    )
    best = top_k(scored, thread, "_score", m, pos)
    made = best.groupBy(thread).agg(ordered_join(pos, text, "\n").alias("_new"))
    return _with_previous(size, made, previous, thread)


def _with_previous(size: DataFrame, made: DataFrame, previous: DataFrame | None, thread: str) -> DataFrame:
    out = size.join(made, thread, "left")
    if previous is None:
        return out.select(thread, F.coalesce("_new", F.lit("")).alias("summary"))
    old = previous.select(thread, F.col("summary").alias("_old"))
    return out.join(old, thread, "left").select(
        thread, F.coalesce("_new", "_old", F.lit("")).alias("summary")
    )


# Checkpoints: rows of thread_id, checkpoint_id, parent_id, ts, state.


def put_checkpoint(history: DataFrame | None, rows: DataFrame, ttl: int = STATE_TTL_SECONDS) -> DataFrame:
    """Append checkpoints. The latest pointer is derived from ts, so there is no second
    write; both expire ``ttl`` seconds after the write."""
    made = rows.withColumn("expires_at", F.col("ts") + F.make_dt_interval(secs=F.lit(ttl)))
    return made if history is None else history.unionByName(made)


def _living(history: DataFrame, as_of: Column) -> DataFrame:
    return history.where((F.col("ts") <= as_of) & (F.col("expires_at") > as_of))


def latest_checkpoint(history: DataFrame, as_of: Column, ids: DataFrame | None = None) -> DataFrame:
    """The last written checkpoint per thread, or those named in ``ids`` (thread_id,
    checkpoint_id); expired and unknown ones give no row. A rewritten id counts once."""
    rows = _living(history, as_of)
    keys = ["thread_id"]
    if ids is not None:
        rows = rows.join(ids.select("thread_id", "checkpoint_id"), ["thread_id", "checkpoint_id"], "left_semi")
        keys = ["thread_id", "checkpoint_id"]
    rest = [c for c in rows.columns if c not in ("thread_id", "ts", "checkpoint_id")]
    newest = F.max(F.struct("ts", "checkpoint_id", *rest)).alias("_c")
    best = rows.groupBy(*keys).agg(newest)
    return best.select("thread_id", *[F.col(f"_c.{c}").alias(c) for c in ("checkpoint_id", "ts", *rest)])


def list_checkpoints(
    history: DataFrame, as_of: Column, before: Column | None = None, limit: int | None = None, where=None
) -> DataFrame:
    """Living checkpoints per thread, newest first."""
    rows = _living(history, as_of)
    if where is not None:
        rows = rows.where(where)
    if before is not None:
        rows = rows.where(F.col("ts") < before)
    if limit is None:
        return rows
    newest = Window.partitionBy("thread_id").orderBy(F.col("ts").desc(), F.col("checkpoint_id").desc())
    return rows.withColumn("rk", F.row_number().over(newest)).where(F.col("rk") <= limit)


def checkpoint_parent(history: DataFrame) -> DataFrame:
    """Attach the parent's ts and state where the parent is known and still stored."""
    parent = history.select(
        "thread_id",
        F.col("checkpoint_id").alias("parent_id"),
        F.col("ts").alias("parent_ts"),
        F.col("state").alias("parent_state"),
    )
    return history.join(parent, ["thread_id", "parent_id"], "left")


def checkpoint_path(history: DataFrame, starts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The checkpoints from each start back to its root: thread_id, start_id, depth,
    checkpoint_id, parent_id, ts, state.

    ``starts`` is (thread_id, checkpoint_id). Branches share their trunk, and each start lists
    it. Parent links are followed by pointer doubling: after r rounds every pointer is 2^r
    links long, so rounds grow with the logarithm of the longest path. A parent that is not
    stored ends the path. Links that form a cycle are followed once round. A rewritten id
    counts once, with its latest row. ``as_of`` leaves out what has expired by then.
    """
    rows = history if as_of is None else _living(history, as_of)
    newest = F.max(F.struct("ts", "parent_id", "state")).alias("_c")
    last = rows.groupBy("thread_id", "checkpoint_id").agg(newest)
    last = cut_lineage(last.select("thread_id", "checkpoint_id", "_c.parent_id", "_c.ts", "_c.state"))
    known = last.select("thread_id", F.col("checkpoint_id").alias("parent_id"))
    hop = last.join(known, ["thread_id", "parent_id"], "left_semi")
    hop = hop.select("thread_id", F.col("checkpoint_id").alias("at"), F.col("parent_id").alias("to"))
    walked = starts.join(last, ["thread_id", "checkpoint_id"], "left_semi").distinct()
    walked = walked.select("thread_id", F.col("checkpoint_id").alias("start_id"), "checkpoint_id")
    walked = cut_lineage(walked.withColumn("depth", F.lit(0).cast("long")))
    span = 1
    while True:
        hop = cut_lineage(hop)
        step = hop.select("thread_id", F.col("at").alias("checkpoint_id"), "to")
        ahead = walked.join(step, ["thread_id", "checkpoint_id"]).select(
            "thread_id", "start_id", F.col("to").alias("checkpoint_id"), (F.col("depth") + span).alias("depth")
        )
        # of a cycle's repetitions the first one counts
        both = walked.unionByName(ahead).groupBy("thread_id", "start_id", "checkpoint_id").agg(F.min("depth").alias("depth"))
        both, before = cut_lineage(both), walked.count()
        walked = both
        if both.count() == before:
            break
        far = hop.select("thread_id", F.col("at").alias("to"), F.col("to").alias("_to"))
        hop = hop.join(far, ["thread_id", "to"]).select("thread_id", "at", F.col("_to").alias("to"))
        span *= 2
    return walked.join(last, ["thread_id", "checkpoint_id"])


def assign_thread(requests: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Give requests without a thread a new one. The ids are random: store the result
    (``cut_lineage``) before using it more than once."""
    given = F.nullif(F.col(thread), F.lit(""))
    return requests.withColumn("is_new", given.isNull()).withColumn(thread, F.coalesce(given, F.uuid()))


def turn_response(log: DataFrame, tasks: DataFrame, thread: str, pos: str, text: str, intents=None) -> DataFrame:
    """Per thread: last message, intent, task and its missing slots (null when none).

    ``tasks`` (thread, template_code, missing) holds the last task, also on turns that did
    not touch it.
    """
    last = log.groupBy(thread).agg(F.max_by(text, pos).alias("_text"))
    out = last.join(tasks, thread, "left")
    if intents is not None:
        out = out.join(intents, thread, "left")
    intent = F.col("intent") if intents is not None else F.lit(None).cast("string")
    return out.select(
        thread,
        F.coalesce("_text", F.lit(NOT_UNDERSTOOD)).alias("response"),
        intent.alias("intent"),
        F.col("template_code").alias("active_task"),
        F.when(F.size("missing") > 0, F.col("missing")).alias("missing_params"),
    )
