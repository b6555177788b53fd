"""The catalogs the registered queries work on, derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.operators.catalogs import (
    build_column_catalog,
    build_table_catalog,
    build_template_catalog,
)
from metaquarry.session import spread
from metaquarry.sources.metadata import generate_columns, generate_tables

UPDATED_AT = 1_700_000_000


def raw_tables(t):
    """One table per part, its subject the part's name and type."""
    subject = F.concat_ws(" ", "p_name", "p_type").alias("subject")
    return generate_tables(spread(t.part.select(F.col("p_partkey").alias("table_no"), subject)))


def raw_columns(t):
    """Columns by table name: tables are dealt before they become many columns with texts."""
    spark = t.spark
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return generate_columns(raw_tables(t).repartition(tasks, "table_name"))


def raw_templates(t):
    """One template per part; some fields are missing, for defaults to fill."""
    size = F.col("p_size")
    slots = F.array(F.lit("source_table"), F.lit("target_table"))
    return spread(t.part).select(
        F.concat(F.lit("template::"), "p_partkey").alias("doc_id"),
        F.concat(F.lit("t"), "p_partkey").alias("template_code"),
        F.concat("p_name", F.lit(" load "), "p_brand").alias("template_name"),
        F.col("p_type").alias("template_type"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("business_domain"),
        F.array(F.lit("MYSQL")).alias("source_types"),
        F.when(size % 3 == 0, F.array(F.lit("HIVE"))).otherwise(F.array(F.lit("DORIS"))).alias("target_types"),
        F.when(size % 2 == 0, slots)
        .otherwise(F.array_append(slots, F.lit("schedule")))
        .alias("required_slots"),
        F.concat(F.lit("moves "), "p_name", F.lit(" "), "p_type", F.lit(" rows")).alias("template_desc"),
        F.when(size % 2 == 0, "LOW").alias("risk_level"),
        F.when(size % 7 == 0, F.lit(False)).alias("is_active"),
        F.create_map(F.lit("mode"), "p_type").alias("default_payload"),
    )


def table_catalog(t, encode=None):
    rows = build_table_catalog(raw_tables(t), UPDATED_AT)
    return rows.withColumn("dense_vector", encode(F.col("search_text"))) if encode else rows


def column_catalog(t, encode=None):
    rows = build_column_catalog(raw_columns(t), raw_tables(t), UPDATED_AT)
    return rows.withColumn("dense_vector", encode(F.col("search_text"))) if encode else rows


def template_catalog(t, encode=None):
    rows = build_template_catalog(raw_templates(t), UPDATED_AT)
    return rows.withColumn("dense_vector", encode(F.col("search_text"))) if encode else rows
