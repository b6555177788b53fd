"""Registered queries through the model hooks, with deterministic stand-in models."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from metaquarry.models import apply_model, model_embedding
from metaquarry.operators import context as cx
from metaquarry.operators import memory as mm
from metaquarry.operators.hybrid import Space
from metaquarry.operators.parsing import NO_TASK, parse_route
from metaquarry.operators.slots import DONE_CLOSE, DONE_OPEN, NEED_CLOSE, NEED_OPEN
from metaquarry.operators.turns import sql_replies, task_replies
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.catalog_data import column_catalog, table_catalog, template_catalog
from metaquarry.plans.registry import query
from metaquarry.plans.search import CATALOG_STAGES, TEMPLATE_DOCS, _catalog_sql, embed, questions


def _length_encoder():
    return lambda texts: [[len(x), x.count(" "), 1.0] for x in texts]


@query(
    "l1_model_embedding",
    """SELECT doc_id, round((a / sqrt(a * a + b * b + 1))::FLOAT::DOUBLE, 5) AS v1,
        round((b / sqrt(a * a + b * b + 1))::FLOAT::DOUBLE, 5) AS v2
      FROM (SELECT doc_id, length('q: ' || text)::DOUBLE AS a,
        (length('q: ' || text) - length(replace('q: ' || text, ' ', '')))::DOUBLE AS b FROM documents)""",
)
def l1(t):
    vecs = t.documents.select("doc_id", model_embedding(F.col("text"), _length_encoder, "q: ").alias("v"))
    return vecs.select(
        "doc_id",
        *[F.round(F.element_at("v", i).cast("double"), 5).alias(f"v{i}") for i in (1, 2)],
    )


@query(
    "l2_apply_model",
    """SELECT conv_id, turn, length('user: ' || text)::VARCHAR AS thought, 'CHAT' AS intent FROM conversations""",
)
def l2(t):
    turns = mm.history_and_input(t.conversations, "conv_id", "turn", "role", "text")
    prompts = turns.select("conv_id", "turn", F.concat(F.lit("user: "), "input").alias("prompt"))
    return parse_route(apply_model(prompts, "prompt")).select("conv_id", "turn", "thought", "intent")


def _first_table_model():
    """Selects from the first table of the prompt; every third such statement deletes."""

    def generate(prompts):
        out = []
        for p in prompts:
            table = re.search(r"Table: (\S+)", p).group(1)
            verb = "DELETE FROM" if int(table.rsplit("_", 1)[1]) % 3 == 0 else "SELECT * FROM"
            out.append(json.dumps({"sql": f"{verb} {table}", "explanation": "first table", "is_safe": True}))
        return out

    return generate


@query(
    "l2_sql_replies",
    sp.with_(
        *CATALOG_STAGES[:10],
        select="""SELECT query_id, CASE WHEN p_partkey % 3 = 0 THEN 'blocked' ELSE 'ok' END AS status,
          CASE WHEN p_partkey % 3 = 0 THEN '检测到生成的 SQL 包含非安全操作，已被拦截。' || chr(10) || '解释: first table'
            ELSE '```sql' || chr(10) || 'SELECT * FROM ' || full_table_name || chr(10) || '```' || chr(10) || chr(10)
              || '**解释**: first table' END AS final_output
          FROM phits JOIN table_catalog USING (doc_id) JOIN part ON p_partkey = table_no WHERE rk = 1""",
    ),
)
def l2_replies(t):
    tables = Space(table_catalog(t, embed))
    columns = Space(column_catalog(t, embed), parent_col="table_id")
    return sql_replies(questions(t), tables, columns, _first_table_model)


def _slot_model():
    """Answers from the first template of the prompt: every fifth answer is no JSON, even
    templates get all their slots, the others only the first."""

    def generate(prompts):
        out = []
        for p in prompts:
            code = re.search(r"Code: (\S+)", p).group(1)
            slots = json.loads(re.search(r"Required Slots: (\[.*?\])", p).group(1))
            n = int(code[1:])
            filled = slots if n % 2 == 0 else slots[:1]
            answer = {
                "task_json": {"mode": code} if n % 2 == 0 else None,
                "extracted_params": dict.fromkeys(filled, "s"),
                "missing_params": slots[len(filled) :],
                "explanation": "first template",
            }
            out.append("sorry" if n % 5 == 4 else json.dumps(answer))
        return out

    return generate


@query(
    "l2_task_replies",
    _catalog_sql(
        TEMPLATE_DOCS,
        (),
        "live",
        "live",
        3,
        f"""SELECT query_id, template_id, collected, status, missing,
          CASE status WHEN 'error' THEN '{NO_TASK}not_json'
            WHEN 'collecting' THEN '{NEED_OPEN}' || replace(missing, ',', ', ') || '{NEED_CLOSE}first template'
            ELSE '{DONE_OPEN}' || '{{' || chr(10) || '  "mode": "t' || n || '"' || chr(10) || '}}'
              || '{DONE_CLOSE}first template' END AS final_output
        FROM (SELECT query_id, template_id, n,
            CASE WHEN n % 5 = 4 THEN 'error' WHEN n % 2 = 0 THEN 'ready' ELSE 'collecting' END AS status,
            CASE WHEN n % 5 = 4 THEN NULL WHEN n % 2 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'target_table'
              ELSE 'target_table,schedule' END AS missing,
            CASE WHEN n % 5 = 4 THEN coalesce('schedule=' || kept, '')
              WHEN n % 2 = 0 AND p_size % 2 = 1 THEN 'schedule=s,source_table=s,target_table=s'
              ELSE coalesce('schedule=' || kept || ',', '')
                || CASE WHEN n % 2 = 0 THEN 'source_table=s,target_table=s' ELSE 'source_table=s' END END AS collected
          FROM (SELECT query_id, own, CASE own % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS kept,
              CASE WHEN own % 3 = 0 THEN 'template::' || own ELSE doc_id END AS template_id,
              CASE WHEN own % 3 = 0 THEN own ELSE substr(doc_id, 11)::BIGINT END AS n
            FROM (SELECT p_name || '/' || p_type AS query_id, min(p_partkey) AS own FROM part GROUP BY 1)
            LEFT JOIN (SELECT query_id, doc_id FROM hits WHERE rk = 1) USING (query_id))
          JOIN part ON p_partkey = n)""",
    ),
)
def l2_tasks(t):
    """A task turn for every kind of part: a third go on with the task they have."""
    own = t.part.groupBy(F.concat_ws("/", "p_name", "p_type").alias("query_id")).agg(F.min("p_partkey").alias("own"))
    collecting = F.col("own") % 3 == 0
    schedule = F.create_map(F.lit("schedule"), F.when(collecting, "daily").otherwise("weekly"))
    state = own.where("own % 3 < 2").select(
        "query_id",
        F.concat(F.lit("template::"), "own").alias("template_id"),
        F.when(collecting, "collecting").otherwise("ready").alias("status"),
        schedule.alias("collected"),
    )
    done = task_replies(questions(t), Space(template_catalog(t, embed)), _slot_model, state)
    pairs = F.transform(F.map_entries("collected"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return done.select(
        "query_id",
        "template_id",
        F.array_join(F.array_sort(pairs), ",").alias("collected"),
        "status",
        F.array_join("missing", ",").alias("missing"),
        "final_output",
    )
