"""Whole turns for many questions at once: retrieve, render, prompt, generate, check, reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.models import apply_model
from metaquarry.operators import context as cx
from metaquarry.operators.audit import gate
from metaquarry.operators.filters import column_filter, table_filter
from metaquarry.operators.hybrid import Space, with_fields
from metaquarry.operators.parsing import NO_TEMPLATES, no_hit_replies, parse_sql_output, parse_task_output
from metaquarry.operators.slots import COLLECTING, merge_params, pretty_json, task_message, task_status
from metaquarry.operators.topk import fits, maybe_broadcast
from metaquarry.session import cut_lineage

SUMMARY_LABEL = "Conversation so far: "
KNOWN_LABEL = "Known values: "
SQL_RULES = (
    "Answer with one read-only SQL statement over these tables and columns only, "
    "as JSON with sql, explanation and is_safe.\n\n"
)
TASK_RULES = (
    "Fill the first fitting template from the conversation, as JSON with task_json, "
    "extracted_params, missing_params and explanation.\n\n"
)
_TABLE_FIELDS = [
    "full_table_name",
    "table_name",
    *cx.TABLE_BLOCK.values(),
    *cx.TABLE_BLOCK_LISTS.values(),
]
_COLUMN_FIELDS = [
    "full_column_name",
    "column_name",
    "data_type",
    "semantic_type",
    "metric_role",
    "column_desc",
]


def _optional(queries: DataFrame) -> DataFrame:
    """Questions without history or summary are first turns."""
    kinds = {"history": "array<struct<role:string,content:string>>", "summary": "string"}
    for name, kind in kinds.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries.withColumn("input", F.col("query_text"))


def sql_prompts(queries: DataFrame, tables: Space, columns: Space) -> tuple[DataFrame, DataFrame]:
    """(prompts of questions with table hits, reply rows of those without)."""
    first, second = cx.search_sql_context(
        queries, tables, columns, parent_filters=table_filter(), child_filters=column_filter()
    )
    key = columns.parent_col
    context = cx.render_schema_context(
        with_fields(first, tables, _TABLE_FIELDS),
        with_fields(second.drop(key), columns, [key, *_COLUMN_FIELDS]),
        tables.id_col,
        key,
    )
    turns = _optional(queries.drop("query_vector")).join(context, "query_id")
    system = F.concat(F.lit(SQL_RULES), F.col("context"))
    return cx.assemble_prompt(turns, system, SUMMARY_LABEL), no_hit_replies(queries, first)


def sql_replies(queries: DataFrame, tables: Space, columns: Space, load) -> DataFrame:
    """query_id, status (ok, blocked, error, no_hit), final_output for every question."""
    prompts, unmet = sql_prompts(queries, tables, columns)
    asked = prompts.select("query_id", cx.render_prompt(F.col("prompt")).alias("prompt"))
    answers = apply_model(asked, "prompt", load).drop("prompt")
    judged = gate(parse_sql_output(answers))
    bad = F.col("status") == "error"
    done = judged.select(
        "query_id",
        F.when(bad, "error").when(F.col("blocked"), "blocked").otherwise("ok").alias("status"),
        F.when(bad, F.col("message")).otherwise(F.col("final_output")).alias("final_output"),
    )
    return done.unionByName(unmet.withColumnRenamed("message", "final_output"))


def _known_params(collected: Column) -> Column:
    """What a thread already knows, as a line for the model; nothing for a first turn."""
    return F.coalesce(F.concat(F.lit(KNOWN_LABEL), F.to_json(collected), F.lit("\n\n")), F.lit(""))


def task_prompts(
    queries: DataFrame, templates: Space, state: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(prompts with the candidate templates, reply rows of questions without any).

    ``state`` (query_id, template_id, status, collected) holds the tasks of earlier turns. A task
    that is still collecting goes on with its own template, and is not searched for again; what
    any earlier task collected is told to the model. Prompts also carry ``template_id`` and
    ``collected``.
    """
    kinds = "query_id %s, template_id %s, status string, collected map<string,string>"
    if state is None:
        names = (queries.schema["query_id"].dataType, templates.rows.schema[templates.id_col].dataType)
        state = queries.sparkSession.createDataFrame([], kinds % tuple(n.simpleString() for n in names))
    going = state.where(F.col("status") == COLLECTING).select("query_id", "template_id")
    # the hits feed both results, so they are computed once
    fresh = queries.join(going, "query_id", "left_anti")
    own = going.join(queries.select("query_id"), "query_id", "left_semi")
    hits = cx.search_templates(fresh, templates).select("query_id", F.col(templates.id_col).alias("template_id"), "rk")
    hits = cut_lineage(hits.unionByName(own.withColumn("rk", F.lit(1))))
    hits = maybe_broadcast(hits, fits(hits))
    fields = templates.rows.withColumnRenamed(templates.id_col, "template_id")
    context = cx.render_templates(fields.join(hits, "template_id"))
    best = hits.where("rk = 1").select("query_id", "template_id")
    known = state.select("query_id", "collected")
    turns = _optional(queries.drop("query_vector")).join(context, "query_id").join(best, "query_id")
    turns = turns.join(known, "query_id", "left")
    system = F.concat(F.lit(TASK_RULES), _known_params(F.col("collected")), F.col("context"))
    unmet = no_hit_replies(queries, hits, NO_TEMPLATES)
    return cx.assemble_prompt(turns, system, SUMMARY_LABEL), unmet


def task_replies(queries: DataFrame, templates: Space, load, state: DataFrame | None = None) -> DataFrame:
    """One task turn for many threads: query_id, status, template_id, collected, missing,
    task_json, final_output.

    Status is collecting, ready, error or no_hit. Collected values are those of earlier turns
    and the model's, which win. A turn whose answer is unusable keeps what was collected.
    """
    prompts, unmet = task_prompts(queries, templates, state)
    asked = prompts.select("query_id", "template_id", "collected", cx.render_prompt(F.col("prompt")).alias("prompt"))
    answers = parse_task_output(apply_model(asked, "prompt", load).drop("prompt"))
    bad = F.col("status") == "error"
    missing = F.col("missing_params")
    said = task_message(missing, pretty_json(F.col("task_json")), F.col("explanation"))
    done = answers.select(
        "query_id",
        F.when(bad, "error").otherwise(task_status(missing)).alias("status"),
        "template_id",
        merge_params(F.col("collected"), F.col("extracted_params")).alias("collected"),
        missing.alias("missing"),
        "task_json",
        F.when(bad, F.col("message")).otherwise(said).alias("final_output"),
    )
    unmet = unmet.withColumnRenamed("message", "final_output")
    return done.unionByName(unmet, allowMissingColumns=True)
