"""Structured model answers: parsing with reasons for failure, routing, intent matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.text import parse_json
from metaquarry.operators.knn import knn_exact

# Intents and what unusable answers become.
SQL_QUERY, TASK_CREATE, CHAT = "SQL_QUERY", "TASK_CREATE", "CHAT"
ERROR_INTENT = "ERROR"
NO_TABLES = "抱歉，我在知识库中未找到与您查询相关的数据表资产。请确认元数据是否已准备完成。"
NO_TEMPLATES = "抱歉，我没有找到相关的任务模板。请尝试描述得更具体一些，例如“从 MySQL 同步到 Doris”。"
NO_SQL = "抱歉，SQL 生成暂时不可用："
NO_TASK = "抱歉，任务生成暂时不可用："
TURN_FAILED = "抱歉，系统内部发生错误，请稍后再试。"
NOT_UNDERSTOOD = "抱歉，我没有理解您的指令。"


def strip_fence(c: Column) -> Column:
    """Drop a Markdown code fence around the answer."""
    return F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*\n|\n?\s*```\s*$", "")


def parsed(c: Column) -> Column:
    """VARIANT of the answer; null if it is not JSON."""
    return parse_json(strip_fence(c))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(_field(v, name))


def _string(v: Column, name: str) -> Column:
    """The field when it is a JSON string, else null."""
    return F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _first_reason(v: Column, checks: list[tuple[Column, str]]) -> Column:
    reason = F.when(v.isNull(), "not_json").when(
        ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_an_object"
    )
    for bad, name in checks:
        reason = reason.when(bad, name)
    return reason


def parse_route(df: DataFrame, response: str = "response") -> DataFrame:
    """Add thought, intent and reason; anything unusable is CHAT. The category is open."""
    v = F.col("_v")
    reason = _first_reason(
        v,
        [
            (_string(v, "thought").isNull(), "thought"),
            (_string(v, "category").isNull(), "category"),
        ],
    )
    out = df.withColumn("_v", parsed(F.col(response))).withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.withColumns(
        {
            "thought": F.when(good, _string(v, "thought")),
            "intent": F.when(good, _string(v, "category")).otherwise(CHAT),
        }
    ).drop("_v")


def parse_sql_output(df: DataFrame, response: str = "response") -> DataFrame:
    """Add sql, explanation, is_safe, status, reason and, for failures, a message."""
    v = F.col("_v")
    reason = _first_reason(
        v,
        [
            (_string(v, "sql").isNull(), "sql"),
            (_string(v, "explanation").isNull(), "explanation"),
            (F.try_variant_get(v, "$.is_safe", "boolean").isNull(), "is_safe"),
        ],
    )
    out = df.withColumn("_v", parsed(F.col(response))).withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.withColumns(
        {
            "sql": F.when(good, _string(v, "sql")),
            "explanation": F.when(good, _string(v, "explanation")),
            "is_safe": F.when(good, F.try_variant_get(v, "$.is_safe", "boolean")),
            "status": F.when(good, "ok").otherwise("error"),
            "message": F.when(~good, F.concat(F.lit(NO_SQL), "reason")),
        }
    ).drop("_v")


def parse_task_output(df: DataFrame, response: str = "response") -> DataFrame:
    """Add task_json, extracted_params, missing_params, explanation, status and reason.

    task_json and extracted_params may be null but must be there.
    """
    v = F.col("_v")

    def bad_object(name):
        kind = _kind(v, name)
        return _field(v, name).isNull() | ~(F.startswith(kind, F.lit("OBJECT")) | (kind == "VOID"))

    missing = F.try_variant_get(v, "$.missing_params", "array<string>")
    reason = _first_reason(
        v,
        [
            (bad_object("task_json"), "task_json"),
            (bad_object("extracted_params"), "extracted_params"),
            (missing.isNull(), "missing_params"),
            (_string(v, "explanation").isNull(), "explanation"),
        ],
    )
    out = df.withColumn("_v", parsed(F.col(response))).withColumn("reason", reason)
    good = F.col("reason").isNull()
    task = _field(v, "task_json")
    return out.withColumns(
        {
            "task_json": F.when(good & ~F.is_variant_null(task), F.to_json(task)),
            "extracted_params": F.when(
                good, F.try_variant_get(v, "$.extracted_params", "map<string,string>")
            ),
            "missing_params": F.when(good, missing),
            "explanation": F.when(good, _string(v, "explanation")),
            "status": F.when(good, "ok").otherwise("error"),
            "message": F.when(~good, F.concat(F.lit(NO_TASK), "reason")),
        }
    ).drop("_v")


def quarantine(parsed_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable rows, unusable rows, count per reason)."""
    bad = parsed_rows.where(F.col("reason").isNotNull())
    return (
        parsed_rows.where(F.col("reason").isNull()),
        bad,
        bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    )


# The branch each intent takes.
BRANCHES = {SQL_QUERY: "sql", TASK_CREATE: "task"}


def route(intent: Column) -> Column:
    """Branch of an intent by exact name; everything else chats."""
    branch = F.lit("chat")
    for name, target in BRANCHES.items():
        branch = F.when(intent == name, target).otherwise(branch)
    return branch


def by_branch(df: DataFrame, intent: str = "intent") -> dict[str, DataFrame]:
    routed = df.withColumn("branch", route(F.col(intent)))
    return {b: routed.where(F.col("branch") == b) for b in ("sql", "task", "chat")}


def classify_intent(messages: DataFrame, examples: DataFrame, threshold: float) -> DataFrame:
    """The intent of the nearest registered example; CHAT when none is near enough.

    ``messages``: query_id, query_vector. ``examples``: example_id, intent, dense_vector.
    """
    near = knn_exact(messages, examples, 1, id_col="example_id")
    labelled = near.join(examples.select("example_id", "intent"), "example_id")
    clear = F.col("cosine") >= threshold
    best = labelled.select("query_id", "cosine", F.when(clear, F.col("intent")).alias("_intent"))
    return (
        messages.select("query_id")
        .join(best, "query_id", "left")
        .select("query_id", F.coalesce("_intent", F.lit(CHAT)).alias("intent"), "cosine")
    )


def no_hit_replies(queries: DataFrame, hits: DataFrame, text: str = NO_TABLES) -> DataFrame:
    """A reply row for every query without any hit."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit("no_hit").alias("status"), F.lit(text).alias("message")
    )


def turn_failures(turns: DataFrame, failed: Column) -> DataFrame:
    """A failed turn answers with the general apology and intent ERROR; others pass."""
    bad = F.coalesce(failed, F.lit(False))
    return turns.withColumns(
        {
            "response": F.when(bad, TURN_FAILED).otherwise(F.col("response")),
            "intent": F.when(bad, ERROR_INTENT).otherwise(F.col("intent")),
        }
    )
