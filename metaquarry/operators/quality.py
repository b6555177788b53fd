"""Data-quality reports over record sets: one aggregation each, one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.schemas import Catalog


def missing_required_fields(df: DataFrame, definition: Catalog) -> list[str]:
    have = set(df.columns)
    return [name for name in definition.required if name not in have]


def extra_fields(df: DataFrame, definition: Catalog) -> list[str]:
    return [name for name in df.columns if name not in set(definition.required)]


def check_required_fields(df: DataFrame, definition: Catalog) -> None:
    missing = missing_required_fields(df, definition)
    if missing:
        raise ValueError(f"{definition.name} lacks required fields: {missing}")


def required_fields_report(df: DataFrame, definition: Catalog) -> DataFrame:
    """One row for a record set: its rows, the required fields it lacks and those it adds."""
    missing, extra = missing_required_fields(df, definition), extra_fields(df, definition)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(definition.name).alias("collection"),
        "n_rows",
        F.lit(",".join(missing)).alias("missing"),
        F.lit(",".join(extra)).alias("extra"),
        F.lit(not missing).alias("complete"),
    )


def check_vector_dim(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """Row, null and wrong-size counts with the sizes met. Null vectors are not wrong."""
    size = F.size(vector_col).cast("long")
    known = F.col(vector_col).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~known).alias("n_null"),
        F.min(F.when(known, size)).alias("min_dim"),
        F.max(F.when(known, size)).alias("max_dim"),
        F.count_if(known & (size != dim)).alias("n_wrong"),
    )


def check_lengths(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per limited column: the longest value and how many exceed the limit; one pass."""
    limits = {c: n for c, n in limits.items() if c in df.columns}
    aggs = []
    for c, n in limits.items():
        length = F.length(F.col(c)).cast("long")
        aggs.append(F.max(length).alias(f"{c}__max"))
        aggs.append(F.count_if(length > n).alias(f"{c}__over"))
    rows = [
        F.struct(
            F.lit(c).alias("field"),
            F.lit(n).cast("long").alias("limit_chars"),
            F.col(f"{c}__max").alias("longest"),
            F.col(f"{c}__over").alias("n_over"),
        )
        for c, n in limits.items()
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def check_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, keys, rows without key and keys used twice.

    Counts per key are combined before the shuffle, so a key on very many rows is one
    row per task there.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    return per_key.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"),
        F.count_if(present).alias("n_keys"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("n_null"),
        F.count_if(present & (n > 1)).alias("n_duplicated"),
    )


def status_report(component: str, report: DataFrame, bad: list[str]) -> DataFrame:
    """ok when every count in ``bad`` is zero, else degraded."""
    clean = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) == 0 for c in bad])
    detail = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in bad])
    return report.select(
        F.lit(component).alias("component"),
        F.when(clean, "ok").otherwise("degraded").alias("status"),
        detail.alias("detail"),
    )


def readiness(reports: list[DataFrame]) -> DataFrame:
    """All component rows, each with the overall status: ok only if all are ok."""
    rows = reduce(DataFrame.unionByName, reports)
    overall = rows.agg(
        F.when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("degraded").alias("o")
    )
    return rows.withColumn("overall", overall.scalar())
