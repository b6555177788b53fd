"""Guard jobs over a log of generated SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.functions import guard as g

#: Logarithm of a sketch's buckets, and its relative standard error.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def gate(
    log: DataFrame, sql: str = "sql", flag: str = "is_safe", explanation: str = "explanation"
) -> DataFrame:
    """Add verdict, block_reasons, denied keywords and final_output to every statement.

    Each text is cleaned, split and searched once; the later columns use the results.
    """
    n, head = F.col("_n"), F.col("_head")
    return (
        log.withColumn("_parts", g.statements(g.strip_comments(F.coalesce(F.col(sql), F.lit("")))))
        .withColumn("_n", F.size("_parts"))
        .withColumn("_head", F.upper(F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))))
        .withColumn("denied", g.denied_keywords(head))
        .withColumn("block_reasons", g.block_reasons(F.col(flag), n, head, F.col("denied")))
        .withColumn("safe_sql", F.size(F.array_except("block_reasons", F.array(F.lit("model_flag")))) == 0)
        .withColumn("blocked", F.size("block_reasons") > 0)
        .withColumn("final_output", g.gate_message(~F.col("blocked"), F.col(sql), F.col(explanation)))
        .drop("_parts", "_n", "_head")
    )


def _blocked_cells(gated: DataFrame, sql: str, *keep: str) -> DataFrame:
    """One row per blocked statement, reason and denied keyword."""
    rows = gated.where("blocked").select(
        *keep, F.md5(sql).alias("_id"), F.explode("block_reasons").alias("reason"), "denied"
    )
    keywords = F.when(F.col("reason") == "denied_keyword", F.col("denied"))
    return rows.select(*keep, "_id", "reason", F.explode_outer(keywords).alias("keyword"))


def audit_sketches(gated: DataFrame, period: str, sql: str = "sql") -> DataFrame:
    """period, reason, keyword, n, sketch: what can be stored of a period and united later.

    The sketch counts different statements in some kilobytes, whatever their number.
    """
    cells = _blocked_cells(gated, sql, period)
    return cells.groupBy(period, "reason", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_id", F.lit(SKETCH_BITS)).alias("sketch")
    )


def united_report(sketches: DataFrame) -> DataFrame:
    """``audit_report`` of stored periods: ``n`` is exact, ``n_distinct`` an estimate whose
    standard error is SKETCH_ERROR."""
    return sketches.groupBy("reason", "keyword").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct")
    )


def audit_report(gated: DataFrame, sql: str = "sql") -> DataFrame:
    """Blocked statements per reason and denied keyword: how many, and how many different."""
    return _blocked_cells(gated, sql).groupBy("reason", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("n_distinct")
    )
