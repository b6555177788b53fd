"""Registered conversation-memory queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.operators import context as cx
from metaquarry.operators import memory as mm
from metaquarry.operators.bm25 import tokenize
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.registry import query
from metaquarry.plans.statements import INTENT, route_responses
from metaquarry.plans.tasks import LOG, MISSING, NEEDS, REQUIRED, _missing
from metaquarry.operators.parsing import parse_route


AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"


@query(
    "j1_append_messages",
    """SELECT conv_id, count(*) AS n, max(turn) AS last_turn, arg_max(role, turn) AS last_role,
      arg_max(text, turn) FILTER (role = 'user') AS last_user_text FROM conversations GROUP BY 1""",
)
def j1(t):
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    log = mm.append_messages(rows.where("turn < 2"), rows.where("turn >= 2"))
    said = log.withColumn("user_text", F.when(F.col("role") == "user", F.col("text")))
    state = mm.latest_fields(said, "conv_id", ["turn"], ["role", "user_text"])
    counts = log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))
    return counts.join(state, "conv_id").select(
        "conv_id", "n", "last_turn", F.col("role").alias("last_role"), F.col("user_text").alias("last_user_text")
    )


def _history_text(h):
    return F.array_join(F.transform(h, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def _history_sql(n: int) -> str:
    return f"""SELECT conv_id, turn, text AS input, coalesce(string_agg(role || ': ' || text, chr(10)) OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') AS history FROM conversations"""


@query("j2_history_and_input", _history_sql(3))
def j2(t):
    out = mm.history_and_input(t.conversations, "conv_id", "turn", "role", "text", 3)
    return out.select("conv_id", "turn", "input", _history_text(F.col("history")).alias("history"))


@query("j2_history_default", _history_sql(12))
def j2_default(t):
    out = mm.history_and_input(t.conversations, "conv_id", "turn", "role", "text")
    return out.select("conv_id", "turn", "input", _history_text(F.col("history")).alias("history"))


def _event_log(t):
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    return mm.positions(rows, "user_id", ["ts", "event_id"])


@query(
    "j3_positions",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events""",
)
def j3_positions(t):
    return _event_log(t).select("user_id", "event_id", "pos")


@query(
    "j3_summary_due",
    """SELECT * FROM (SELECT user_id, event_id, row_number() OVER w AS n_messages, string_agg(event_id, ',') OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS win
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n_messages >= 24""",
)
def j3(t):
    due = mm.summary_due(_event_log(t), "user_id", "pos", "event_id")
    return due.select("user_id", "event_id", "n_messages", F.array_join(F.col("window").cast("array<string>"), ",").alias("win"))


@query(
    "j4_summarize",
    sp.with_(
        f"""words AS (SELECT DISTINCT conv_id, turn, term FROM
          (SELECT conv_id, turn, unnest({sp.tokens("text")}) AS term FROM conversations))""",
        "idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM conversations) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM words GROUP BY 1)",
        "score AS (SELECT conv_id, turn, round(avg(idf), 4) AS score FROM words JOIN idf USING (term) GROUP BY 1, 2)",
        "size AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1)",
        """best AS (SELECT * FROM (SELECT conv_id, turn, text, row_number() OVER
            (PARTITION BY conv_id ORDER BY coalesce(score, 0) DESC, turn) AS rk
          FROM conversations JOIN size USING (conv_id) LEFT JOIN score USING (conv_id, turn)
          WHERE n >= 4 AND turn >= n - 4) WHERE rk <= 2)""",
        "made AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS summary FROM best GROUP BY 1)",
        select="""SELECT conv_id, coalesce(summary, text, '') AS summary FROM size LEFT JOIN made USING (conv_id)
          LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) USING (conv_id)""",
    ),
)
def j4(t):
    c = t.conversations
    words = c.select(
        "conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term")
    )
    previous = c.where("turn = 0").select("conv_id", F.col("text").alias("summary"))
    return mm.summarize(
        c, words, "conv_id", "turn", "text", m=2, trigger=4, window=4, previous=previous
    )


def checkpoints(t):
    """Events as checkpoints of their user's thread, each after the one before it."""
    rows = t.events.select(
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("checkpoint_id"),
        F.col("ts"),
        F.col("event_type").alias("state"),
    )
    return mm.previous_value(rows, "thread_id", "checkpoint_id", "checkpoint_id", name="parent_id")


CHECKPOINTS = """
checkpoints AS (SELECT user_id AS thread_id, event_id AS checkpoint_id, ts, event_type AS state,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id,
  ts + INTERVAL 7 DAY AS expires_at FROM events)"""


@query(
    "j5_put_checkpoint",
    sp.with_(
        CHECKPOINTS,
        select="""SELECT thread_id, checkpoint_id, parent_id, state, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires
          FROM checkpoints""",
    ),
)
def j5(t):
    rows = checkpoints(t)
    history = mm.put_checkpoint(None, rows.where("state <> 'click'"))
    history = mm.put_checkpoint(history, rows.where("state = 'click'"))
    return history.select(
        "thread_id", "checkpoint_id", "parent_id", "state", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires")
    )


@query(
    "j6_latest_checkpoint",
    sp.with_(
        CHECKPOINTS,
        select=f"""SELECT thread_id, arg_max(checkpoint_id, (ts, checkpoint_id)) AS checkpoint_id,
          arg_max(state, (ts, checkpoint_id)) AS state, arg_max(parent_id, (ts, checkpoint_id)) AS parent_id
          FROM checkpoints WHERE ts <= {AS_OF} AND expires_at > {AS_OF} GROUP BY 1""",
    ),
)
def j6(t):
    history = mm.put_checkpoint(None, checkpoints(t))
    latest = mm.latest_checkpoint(history, F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return latest.select("thread_id", "checkpoint_id", "state", "parent_id")


@query(
    "j6_checkpoint_by_id",
    sp.with_(
        CHECKPOINTS,
        select=f"""SELECT thread_id, checkpoint_id, state FROM checkpoints WHERE ts <= {AS_OF} AND expires_at > {AS_OF}
          AND (thread_id, checkpoint_id) IN (SELECT (conv_id, turn * 500 + 9000) FROM conversations
            UNION ALL SELECT (user_id, event_id) FROM events WHERE event_type = 'purchase')""",
    ),
)
def j6_by_id(t):
    history = mm.put_checkpoint(None, checkpoints(t))
    ids = t.conversations.select(
        F.col("conv_id").alias("thread_id"), (F.col("turn") * 500 + 9000).alias("checkpoint_id")
    ).unionByName(
        t.events.where("event_type = 'purchase'").select(
            F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id")
        )
    )
    found = mm.latest_checkpoint(history, F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")), ids)
    return found.select("thread_id", "checkpoint_id", "state")


@query(
    "j7_list_checkpoints",
    sp.with_(
        CHECKPOINTS,
        select=f"""SELECT thread_id, checkpoint_id, rk FROM (SELECT *, row_number() OVER
          (PARTITION BY thread_id ORDER BY ts DESC, checkpoint_id DESC) AS rk FROM checkpoints
          WHERE ts <= {AS_OF} AND expires_at > {AS_OF} AND ts < TIMESTAMP '2024-01-28 12:00:00'
            AND state IN ('view', 'click')) WHERE rk <= 5""",
    ),
)
def j7(t):
    from metaquarry.operators.filters import build_filter

    history = mm.put_checkpoint(None, checkpoints(t))
    rows = mm.list_checkpoints(
        history,
        F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")),
        before=F.expr("TIMESTAMP_NTZ '2024-01-28 12:00:00'"),
        limit=5,
        where=build_filter({"state": ["view", "click"], "thread_id": None}),
    )
    return rows.select("thread_id", "checkpoint_id", "rk")


@query(
    "j8_checkpoint_parent",
    sp.with_(
        CHECKPOINTS,
        select="""SELECT c.thread_id, c.checkpoint_id, c.parent_id, p.state AS parent_state FROM checkpoints c
          LEFT JOIN checkpoints p ON c.thread_id = p.thread_id AND c.parent_id = p.checkpoint_id""",
    ),
)
def j8(t):
    rows = mm.checkpoint_parent(mm.put_checkpoint(None, checkpoints(t)))
    return rows.select("thread_id", "checkpoint_id", "parent_id", "parent_state")


@query(
    "j8_checkpoint_path",
    """WITH RECURSIVE numbered AS (SELECT user_id AS thread_id, event_id AS checkpoint_id, event_type AS state,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
      linked AS (SELECT a.*, b.checkpoint_id AS parent_id FROM numbered a LEFT JOIN numbered b
        ON a.thread_id = b.thread_id AND b.pos = CASE WHEN a.pos % 7 = 3 THEN a.pos - 3 ELSE a.pos - 1 END),
      path AS (SELECT thread_id, checkpoint_id AS start_id, 0::BIGINT AS depth, checkpoint_id, parent_id, state FROM linked
        WHERE pos % 50 >= 48
        UNION ALL SELECT p.thread_id, p.start_id, p.depth + 1, l.checkpoint_id, l.parent_id, l.state
        FROM path p JOIN linked l ON p.thread_id = l.thread_id AND p.parent_id = l.checkpoint_id)
      SELECT * FROM path""",
)
def j8_path(t):
    """From some checkpoints of every thread back to its root; a seventh of them branch off."""
    rows = _event_log(t)
    made = rows.select(
        F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id"), "pos", "ts", F.col("event_type").alias("state")
    )
    before = F.when(F.col("pos") % 7 == 3, F.col("pos") - 3).otherwise(F.col("pos") - 1)
    parents = made.select("thread_id", F.col("pos").alias("_before"), F.col("checkpoint_id").alias("parent_id"))
    made = made.withColumn("_before", before).join(parents, ["thread_id", "_before"], "left").drop("_before")
    starts = made.where("pos % 50 >= 48").select("thread_id", "checkpoint_id")
    path = mm.checkpoint_path(mm.put_checkpoint(None, made.drop("pos")), starts)
    return path.select("thread_id", "start_id", "depth", "checkpoint_id", "parent_id", "state")


@query(
    "j9_assign_thread",
    """SELECT conv_id, turn, role = 'system' AS is_new, CASE WHEN role = 'system' THEN 36 ELSE length('c' || conv_id) END AS id_length
      FROM conversations""",
)
def j9(t):
    given = F.when(F.col("role") == "system", F.when(F.col("turn") > 0, "")).otherwise(
        F.concat(F.lit("c"), "conv_id")
    )
    out = mm.assign_thread(t.conversations.withColumn("thread_id", given))
    return out.select("conv_id", "turn", "is_new", F.length("thread_id").cast("long").alias("id_length"))


@query(
    "j10_turn_response",
    sp.with_(
        LOG,
        REQUIRED,
        NEEDS,
        MISSING,
        f"""said AS (SELECT conv_id, arg_max(text, turn) AS response, arg_max({INTENT}, turn) AS intent
          FROM conversations GROUP BY 1)""",
        select="""SELECT conv_id, response, intent, CASE thread_id % 3 WHEN 0 THEN 'site_survey' WHEN 1 THEN 'exhibit_loan'
          WHEN 2 THEN 'digest' END AS active_task, nullif(missing, '') AS missing_params
          FROM said LEFT JOIN missing_list ON conv_id = thread_id""",
    ),
)
def j10(t):
    tasks = _missing(t).select(F.col("thread_id").alias("conv_id"), "template_code", "missing")
    intents = mm.latest_fields(parse_route(route_responses(t)), "conv_id", ["turn"], ["intent"])
    out = mm.turn_response(t.conversations, tasks, "conv_id", "turn", "text", intents)
    return out.withColumn("missing_params", F.array_join("missing_params", ","))


@query(
    "f5_assemble_prompt",
    f"""SELECT conv_id, turn, 'system: answer from the notes' || chr(10) || 'system: so far: ' || n || ' messages'
      || chr(10) || CASE WHEN history <> '' THEN history || chr(10) ELSE '' END || 'user: ' || input AS prompt
    FROM ({_history_sql(12)}) JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)
    JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn) WHERE role = 'user'""",
)
def f5(t):
    turns = mm.history_and_input(t.conversations, "conv_id", "turn", "role", "text").where("role = 'user'")
    sizes = t.conversations.groupBy("conv_id").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" messages")).alias("summary")
    )
    prompts = cx.assemble_prompt(turns.join(sizes, "conv_id"), F.lit("answer from the notes"), "so far: ")
    return prompts.select("conv_id", "turn", cx.render_prompt(F.col("prompt")).alias("prompt"))
