"""Registered queries over statement and response logs derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.functions import guard as g
from metaquarry.functions.text import tokens
from metaquarry.operators import context as cx
from metaquarry.operators import parsing as ps
from metaquarry.operators.audit import SKETCH_ERROR, audit_report, audit_sketches, gate, united_report
from metaquarry.operators.bm25 import bm25_search
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.registry import query
from metaquarry.plans.search import DIM, embed, text_queries
from metaquarry.session import new_run_dir

# --------------------------------------------------------------------------- statement log


def statements(t):
    """A statement per message, its form chosen by the thread, the message text inside it."""
    c = t.conversations
    text = F.coalesce(F.col("text"), F.lit(""))
    lit = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    form = F.pmod("conv_id", F.lit(8))
    forms = [
        F.concat(F.lit("SELECT * FROM notes WHERE body = "), lit),
        F.concat(F.lit("SELECT 1 /* DROP "), text, F.lit(" */ , 2;")),
        F.concat(F.lit("SELECT "), lit, F.lit("; SELECT 2")),
        F.concat(F.lit("DELETE FROM notes WHERE body = "), lit),
        F.concat(F.lit("with c as (select "), lit, F.lit(" b) select * from c where last_update > 1")),
        F.concat(F.lit("-- drop\nSELECT "), lit),
        F.concat(F.lit("update notes set body = "), lit),
        F.concat(F.lit("SELECT "), lit, F.lit(" -- drop and create")),
    ]
    sql = F.element_at(F.array(*forms), (form + 1).cast("int"))
    sql = F.when(F.pmod("turn", F.lit(7)) == 6, "  ").otherwise(sql)
    return c.select(
        "conv_id",
        "turn",
        sql.alias("sql"),
        (F.pmod(F.col("turn"), F.lit(3)) != 2).alias("is_safe"),
        F.concat(F.lit("turn "), F.col("turn")).alias("explanation"),
    )


LOG = r"""
log AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '  ' ELSE CASE conv_id % 8
    WHEN 0 THEN 'SELECT * FROM notes WHERE body = ' || lit
    WHEN 1 THEN 'SELECT 1 /* DROP ' || text || ' */ , 2;'
    WHEN 2 THEN 'SELECT ' || lit || '; SELECT 2'
    WHEN 3 THEN 'DELETE FROM notes WHERE body = ' || lit
    WHEN 4 THEN 'with c as (select ' || lit || ' b) select * from c where last_update > 1'
    WHEN 5 THEN '-- drop' || chr(10) || 'SELECT ' || lit
    WHEN 6 THEN 'update notes set body = ' || lit
    ELSE 'SELECT ' || lit || ' -- drop and create' END END AS sql,
    turn % 3 <> 2 AS is_safe, 'turn ' || turn AS explanation
  FROM (SELECT *, '''' || replace(text, '''', '''''') || '''' AS lit FROM conversations)),
cleaned AS (SELECT *, regexp_replace(sql, '(--[^\n]*\n)|(/\*(.|\n)*?\*/)', ' ', 'g') AS clean FROM log),
parts AS (SELECT *, list_filter(list_transform(string_split(clean, ';'),
    lambda s: @STRIP@), lambda s: s <> '') AS stmts FROM cleaned),
first AS (SELECT *, len(stmts) AS n_stmts, upper(coalesce(stmts[1], '')) AS head FROM parts)""".replace(
    "@STRIP@", sp.strip("s")
)

_LEFT, _RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
FOUND = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(head, '{_LEFT}{w}{_RIGHT}') THEN '{w}' END" for w in g.DENIED
) + "], lambda w: w IS NOT NULL)"
DENIED = f"regexp_matches(head, '{_LEFT}({'|'.join(g.DENIED)}){_RIGHT}')"
PREFIX = "regexp_matches(head, '^(SELECT|WITH)')"
SAFE = f"(n_stmts = 1 AND {PREFIX} AND NOT {DENIED})"
REASONS = f"""list_filter([CASE WHEN NOT is_safe THEN 'model_flag' END, CASE WHEN n_stmts = 0 THEN 'empty' END,
  CASE WHEN n_stmts > 1 THEN 'multiple_statements' END,
  CASE WHEN n_stmts = 1 AND NOT {PREFIX} THEN 'not_read_only' END,
  CASE WHEN n_stmts = 1 AND {DENIED} THEN 'denied_keyword' END], lambda r: r IS NOT NULL)"""


def _guard_sql(columns: str) -> str:
    return sp.with_(LOG, select=f"SELECT conv_id, turn, {columns} FROM first")


@query("g1_strip_comments", _guard_sql("clean AS cleaned"))
def g1(t):
    return statements(t).select("conv_id", "turn", g.strip_comments(F.col("sql")).alias("cleaned"))


@query("g2_single_statement", _guard_sql("n_stmts, n_stmts = 1 AS single"))
def g2(t):
    clean = g.strip_comments(F.col("sql"))
    return statements(t).select(
        "conv_id",
        "turn",
        F.size(g.statements(clean)).cast("long").alias("n_stmts"),
        g.single_statement(clean).alias("single"),
    )


@query("g3_read_only_prefix", _guard_sql(f"{PREFIX} AS read_only"))
def g3(t):
    head = g.first_statement(g.strip_comments(F.col("sql")))
    return statements(t).select("conv_id", "turn", g.is_read_only_prefix(head).alias("read_only"))


@query("g4_denied_keywords", _guard_sql(f"{DENIED} AS denied, array_to_string({FOUND}, ',') AS keywords"))
def g4(t):
    head = g.first_statement(g.strip_comments(F.col("sql")))
    return statements(t).select(
        "conv_id",
        "turn",
        g.has_denied_keyword(head).alias("denied"),
        F.array_join(g.denied_keywords(head), ",").alias("keywords"),
    )


@query("g5_is_safe_sql", _guard_sql(f"{SAFE} AS safe"))
def g5(t):
    return statements(t).select("conv_id", "turn", g.is_safe_sql(F.col("sql")).alias("safe"))


# Blanks that only Unicode knows, around the statement and after its semicolon.
WIDE_BLANKS = ["\u3000", "\u00a0", "\u2003\u2028", "\u0085"]
_WIDE_SQL = f"""CASE WHEN turn % 7 = 6 THEN '  ' ELSE {sp.pick(WIDE_BLANKS, "turn")} || CASE conv_id % 8"""


@query(
    "g5_is_safe_sql_blanks",
    _guard_sql(f"{SAFE} AS safe")
    .replace("CASE WHEN turn % 7 = 6 THEN '  ' ELSE CASE conv_id % 8", _WIDE_SQL)
    .replace("' -- drop and create' END END AS sql", f"' -- drop and create' END || ';' || {sp.pick(WIDE_BLANKS, 'turn + 1')} END AS sql"),
)
def g5_blanks(t):
    blanks = F.array(*map(F.lit, WIDE_BLANKS))
    before, after = (F.element_at(blanks, F.pmod(F.col("turn") + k, F.lit(4)).cast("int") + 1) for k in (0, 1))
    wide = F.when(F.pmod("turn", F.lit(7)) == 6, F.col("sql")).otherwise(
        F.concat(before, F.col("sql"), F.lit(";"), after)
    )
    return statements(t).select("conv_id", "turn", g.is_safe_sql(wide).alias("safe"))


@query(
    "g6_gate",
    _guard_sql(
        f"""array_to_string({REASONS}, ',') AS reasons, CASE WHEN is_safe AND {SAFE}
      THEN '```sql' || chr(10) || sql || chr(10) || '```' || chr(10) || chr(10) || '**解释**: ' || explanation
      ELSE '检测到生成的 SQL 包含非安全操作，已被拦截。' || chr(10) || '解释: ' || explanation END AS final_output"""
    ),
)
def g6(t):
    return gate(statements(t)).select(
        "conv_id", "turn", F.array_join("block_reasons", ",").alias("reasons"), "final_output"
    )


@query(
    "g7_audit_report",
    sp.with_(
        LOG,
        f"""hits AS (SELECT sql, unnest({REASONS}) AS reason, {FOUND} AS found FROM first),
        cells AS (SELECT sql, reason, unnest(CASE WHEN reason = 'denied_keyword' THEN found ELSE [NULL] END) AS keyword
          FROM hits)""",
        select="""SELECT reason, keyword, count(*) AS n, count(DISTINCT sql) AS n_distinct FROM cells GROUP BY 1, 2""",
    ),
)
def g7(t):
    return audit_report(gate(statements(t)))


@query(
    "g7_audit_sketches",
    sp.with_(
        LOG,
        f"""hits AS (SELECT sql, unnest({REASONS}) AS reason, {FOUND} AS found FROM first),
        cells AS (SELECT sql, reason, unnest(CASE WHEN reason = 'denied_keyword' THEN found ELSE [NULL] END) AS keyword
          FROM hits)""",
        select="""SELECT reason, keyword, count(*) AS n, count(DISTINCT sql) AS exact, true AS within_bounds
          FROM cells GROUP BY 1, 2""",
    ),
)
def g7_sketches(t):
    """Counts of different statements from stored sketches of each turn number, united; are they
    within three standard errors of the exact ones?"""
    gated = gate(statements(t))
    path = new_run_dir(t.spark, "sketches")
    audit_sketches(gated, "turn").write.partitionBy("turn").parquet(path)
    about = united_report(t.spark.read.parquet(path))
    exact = audit_report(gated).withColumnsRenamed({"n": "n_all", "n_distinct": "exact"})
    same = about["reason"].eqNullSafe(exact["reason"]) & about["keyword"].eqNullSafe(exact["keyword"])
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 3 * SKETCH_ERROR * F.col("exact")
    return about.join(exact, same).select(
        about["reason"], about["keyword"], "n", "exact", near.alias("within_bounds")
    )


# What the strict lexer leaves out: literals, quoted names and comments.
OUTSIDE = r"""regexp_replace(sql,
  '(''(''''|[^''])*'')|("(""|[^"])*")|(`(``|[^`])*`)|(--[^\n]*(\n|$))|(/\*(.|\n)*?\*/)', ' ', 'g')"""


@query(
    "g5_is_safe_sql_strict",
    sp.with_(
        LOG,
        f"bare AS (SELECT conv_id, turn, {OUTSIDE} AS code FROM log)",
        f"""pieces AS (SELECT *, list_filter(list_transform(string_split(code, ';'), lambda s: {sp.strip("s")}),
          lambda s: s <> '') AS stmts FROM bare)""",
        "heads AS (SELECT *, len(stmts) AS n_stmts, upper(coalesce(stmts[1], '')) AS head FROM pieces)",
        select=f"""SELECT conv_id, turn, n_stmts = 1 AND regexp_matches(head, '^(SELECT|WITH){_RIGHT}') AND NOT {DENIED}
          AND NOT regexp_matches(code, '[''"`]|/[*]') AS safe FROM heads""",
    ),
)
def g5_strict(t):
    return statements(t).select("conv_id", "turn", g.is_safe_sql_strict(F.col("sql")).alias("safe"))


# --------------------------------------------------------------------------- response log


def _escaped(c):
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


ESCAPED = (
    r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
)


def _responses(t, forms):
    """A model answer per message; its form is chosen by the turn."""
    said = _escaped(F.coalesce("text", F.lit("")))
    built = [f(said) for f in forms]
    at = F.pmod("turn", F.lit(len(forms))) + 1
    return t.conversations.select("conv_id", "turn", F.element_at(F.array(*built), at.cast("int")).alias("response"))


def route_responses(t):
    return _responses(
        t,
        [
            lambda s: F.concat(F.lit('{"thought": "'), s, F.lit('", "category": "SQL_QUERY"}')),
            lambda s: F.concat(F.lit('```json\n{"thought": "'), s, F.lit('", "category": "TASK_CREATE"}\n```')),
            lambda s: F.concat(F.lit("I think "), s),
            lambda s: F.concat(F.lit('{"thought": "'), s, F.lit('"}')),
            lambda s: F.concat(F.lit('{"thought": "'), s, F.lit('", "category": 5}')),
            lambda s: F.concat(F.lit('{"thought": "'), s, F.lit('", "category": "OTHER"}')),
        ],
    )


INTENT = """CASE turn % 6 WHEN 0 THEN 'SQL_QUERY' WHEN 1 THEN 'TASK_CREATE' WHEN 5 THEN 'OTHER' ELSE 'CHAT' END"""


@query(
    "h1_parse_route",
    f"""SELECT conv_id, turn, {INTENT} AS intent,
      CASE WHEN turn % 6 IN (0, 1, 5) THEN text END AS thought,
      CASE turn % 6 WHEN 2 THEN 'not_json' WHEN 3 THEN 'category' WHEN 4 THEN 'category' END AS reason
    FROM conversations""",
)
def h1(t):
    return ps.parse_route(route_responses(t)).drop("response")


@query(
    "h2_parse_sql_output",
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN text END AS sql,
      CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'why' END AS explanation,
      CASE turn % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_safe,
      CASE WHEN turn % 4 < 2 THEN 'ok' ELSE 'error' END AS status,
      CASE turn % 4 WHEN 2 THEN 'is_safe' WHEN 3 THEN 'not_an_object' END AS reason,
      CASE turn % 4 WHEN 2 THEN '{ps.NO_SQL}is_safe' WHEN 3 THEN '{ps.NO_SQL}not_an_object' END AS message
    FROM conversations""",
)
def h2(t):
    responses = _responses(
        t,
        [
            lambda s: F.concat(F.lit('{"sql": "SELECT 1", "explanation": "'), s, F.lit('", "is_safe": true}')),
            lambda s: F.concat(F.lit('{"sql": "'), s, F.lit('", "explanation": "why", "is_safe": false}')),
            lambda s: F.concat(F.lit('{"sql": "'), s, F.lit('", "explanation": "why"}')),
            lambda s: F.concat(F.lit('["'), s, F.lit('"]')),
        ],
    )
    return ps.parse_sql_output(responses).drop("response")


@query(
    "h3_parse_task_output",
    f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text END AS said,
      CASE turn % 3 WHEN 0 THEN conv_id END AS table_no, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'a,b' END AS missing,
      CASE turn % 3 WHEN 0 THEN 'done' WHEN 1 THEN text END AS explanation,
      CASE WHEN turn % 3 < 2 THEN 'ok' ELSE 'error' END AS status,
      CASE turn % 3 WHEN 2 THEN 'missing_params' END AS reason FROM conversations""",
)
def h3(t):
    number = F.col("conv_id").cast("string")
    responses = _responses(
        t,
        [
            lambda s: F.concat(
                F.lit('{"task_json": {"n": '), number, F.lit('}, "extracted_params": {"said": "'), s,
                F.lit('"}, "missing_params": [], "explanation": "done"}'),
            ),
            lambda s: F.concat(
                F.lit('{"task_json": null, "extracted_params": {}, "missing_params": ["a", "b"], "explanation": "'),
                s, F.lit('"}'),
            ),
            lambda s: F.concat(
                F.lit('{"task_json": null, "extracted_params": null, "explanation": "'), s, F.lit('"}')
            ),
        ],
    )
    rows = ps.parse_task_output(responses)
    return rows.select(
        "conv_id",
        "turn",
        F.element_at("extracted_params", "said").alias("said"),
        F.get_json_object("task_json", "$.n").cast("long").alias("table_no"),
        F.array_join("missing_params", ",").alias("missing"),
        "explanation",
        "status",
        "reason",
    )


@query(
    "h3_quarantine",
    """SELECT CASE turn % 6 WHEN 2 THEN 'not_json' ELSE 'category' END AS reason, count(*) AS n
      FROM conversations WHERE turn % 6 IN (2, 3, 4) GROUP BY 1""",
)
def h3_quarantine(t):
    return ps.quarantine(ps.parse_route(route_responses(t)))[2]


@query(
    "h4_route",
    f"""SELECT intent, CASE intent WHEN 'SQL_QUERY' THEN 'sql' WHEN 'TASK_CREATE' THEN 'task' ELSE 'chat' END AS branch,
      count(*) AS n FROM (SELECT {INTENT} AS intent FROM conversations) GROUP BY 1, 2""",
)
def h4(t):
    rows = ps.parse_route(route_responses(t))
    return rows.groupBy("intent", ps.route(F.col("intent")).alias("branch")).agg(F.count(F.lit(1)).alias("n"))


NAMES = [ps.SQL_QUERY, ps.TASK_CREATE, ps.CHAT]


@query(
    "h5_classify_intent",
    sp.with_(
        sp.hashed("q", "SELECT conv_id * 100 + turn AS query_id, text AS txt FROM conversations WHERE role = 'user'", DIM, "query_id"),
        sp.hashed("e", "SELECT item_id AS doc_id, text AS txt FROM benchmark", DIM),
        sp.dense("", "SELECT query_id, v AS qv FROM qemb", "SELECT doc_id, v FROM eemb"),
        sp.ranked("hits", "cos", "cosine", 1),
        select=f"""SELECT query_id, cosine, CASE WHEN cosine >= 0.8
          THEN {sp.pick(NAMES, "doc_id")} ELSE 'CHAT' END AS intent FROM hits""",
    ),
)
def h5(t):
    said = t.conversations.where("role = 'user'")
    messages = said.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), embed(F.col("text")).alias("query_vector")
    )
    label = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    examples = t.benchmark.select(
        F.col("item_id").alias("example_id"), label.alias("intent"), embed(F.col("text")).alias("dense_vector")
    )
    return ps.classify_intent(messages, examples, 0.8)


@query(
    "h6_no_hit_replies",
    sp.with_(
        sp.counted("", "SELECT doc_id, text AS txt, lang, source FROM documents", "lang, source"),
        sp.bm25("", "SELECT item_id AS query_id, text AS txt FROM benchmark", "lang = 'es' AND source = 'src7'"),
        select=f"""SELECT item_id AS query_id, 'no_hit' AS status, '{ps.NO_TABLES}' AS message FROM benchmark
          WHERE item_id NOT IN (SELECT query_id FROM sparse)""",
    ),
)
def h6(t):
    qs = text_queries(t)
    where = (F.col("lang") == "es") & (F.col("source") == "src7")
    hits = bm25_search(qs, t.documents, 5, carried=("lang", "source"), where=where)
    return ps.no_hit_replies(qs, hits)


@query(
    "h6_turn_failures",
    f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{ps.TURN_FAILED}' ELSE text END AS response,
      CASE WHEN role = 'system' THEN 'ERROR' ELSE {INTENT} END AS intent FROM conversations""",
)
def h6_turns(t):
    routed = ps.parse_route(route_responses(t)).select("conv_id", "turn", "intent")
    turns = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("response"))
    turns = turns.join(routed, ["conv_id", "turn"])
    return ps.turn_failures(turns, F.col("role") == "system").drop("role")


# --------------------------------------------------------------------------- prompts


@query(
    "f4_intent_options",
    """WITH names AS (SELECT lang AS name, min(doc_id) AS ord, count(*) || ' documents' AS description
        FROM documents GROUP BY 1)
      SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) AS options FROM names""",
)
def f4_options(t):
    """The languages as intents, in the order in which the documents first have them."""
    intents = t.documents.groupBy(F.col("lang").alias("name")).agg(
        F.min("doc_id").alias("ord"),
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" documents")).alias("description"),
    )
    return cx.intent_options(intents)


@query(
    "f4_few_shot",
    """SELECT role AS name, string_agg('User: ' || text || chr(10) || 'Intent: ' || role, chr(10) ORDER BY n) AS shots
      FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id * 100 + turn) AS n
        FROM conversations) WHERE n <= 3 GROUP BY 1""",
)
def f4_few_shot(t):
    examples = t.conversations.select(
        F.col("role").alias("name"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ord"),
        F.col("text").alias("example"),
    )
    return cx.few_shot(examples)
