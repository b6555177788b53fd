"""From raw metadata to the three search catalogs (without vectors; see ``with_vectors``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.text import (
    column_doc_id,
    first_filled,
    metric_role,
    normalize_json,
    search_text,
    semantic_type,
    table_doc_id,
)
from metaquarry.models import hash_embedding
from metaquarry.schemas import EMBEDDING_DIM


def _optional(df: DataFrame, name: str, kind: str = "string"):
    """The column, or a typed null where the raw data does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _or(df: DataFrame, name: str, default=""):
    return F.coalesce(_optional(df, name), F.lit(default))


def _no_items():
    return F.array().cast("array<string>")


# What every catalog row starts with and is marked as.
FIXED = {"tenant_id": "default", "env": "dev", "status": "ACTIVE"}
SCHEMA_VERSION = 1
SECURITY, DIALECT, FALLBACK = "INTERNAL", "ANSI", "default"


def _head():
    return [F.lit(v).alias(n) for n, v in FIXED.items()] + [
        F.lit(SCHEMA_VERSION).cast("long").alias("schema_version")
    ]


def _payload(df: DataFrame):
    return F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload")


def _now(updated_at):
    return (F.unix_timestamp() if updated_at is None else F.lit(updated_at)).cast("long")


def build_table_catalog(raw: DataFrame, updated_at: int | None = None) -> DataFrame:
    """One projection; the id may fall back to the database name, the full name does not."""
    name, comment = F.col("table_name"), _or(raw, "table_comment")
    schema = first_filled(_optional(raw, "schema_name"), F.lit(FALLBACK))
    return raw.select(
        table_doc_id(_optional(raw, "schema_name"), _optional(raw, "database_name"), name).alias(
            "doc_id"
        ),
        *_head(),
        _or(raw, "data_source", FALLBACK).alias("datasource_id"),
        F.lit("").alias("catalog_name"),
        schema.alias("database_name"),
        schema.alias("schema_name"),
        name,
        F.concat_ws(".", schema, name).alias("full_table_name"),
        F.when(_optional(raw, "is_fact_table", "boolean"), "FACT").otherwise("DIM").alias("table_type"),
        F.lit(DIALECT).alias("dialect"),
        name.alias("business_name"),
        F.array(name).alias("aliases"),
        _or(raw, "business_domain").alias("business_domain"),
        comment.alias("grain_desc"),
        comment.alias("table_desc"),
        *[_no_items().alias(c) for c in ("primary_keys", "partition_keys", "time_columns", "join_hints")],
        *[F.lit("").alias(c) for c in ("row_count_level", "freshness_sla", "owner")],
        F.lit(SECURITY).alias("security_level"),
        F.lit(True).alias("is_active"),
        search_text(
            _optional(raw, "text"),
            name,
            comment,
            _optional(raw, "business_domain"),
            _optional(raw, "data_source"),
        ).alias("search_text"),
        _payload(raw),
        _now(updated_at).alias("updated_at"),
    )


def build_column_catalog(
    raw: DataFrame, raw_tables: DataFrame, updated_at: int | None = None, order: str = "table_no"
) -> DataFrame:
    """Columns with their table's schema and source; the last table of a name counts."""
    owner = raw_tables.groupBy("table_name").agg(
        F.max_by(
            F.struct(
                first_filled(
                    _optional(raw_tables, "schema_name"),
                    _optional(raw_tables, "database_name"),
                    F.lit(FALLBACK),
                ).alias("schema"),
                _or(raw_tables, "data_source", FALLBACK).alias("source"),
            ),
            F.col(order),
        ).alias("_owner")
    )
    # many columns have long texts: they should neither be sorted nor, if they come by table, be moved
    df = raw.withColumn("_payload", F.to_json(F.struct(*raw.columns))).join(
        owner.hint("shuffle_hash"), "table_name", "left"
    )
    schema = first_filled(
        _optional(raw, "schema_name"),
        _optional(raw, "database_name"),
        F.col("_owner.schema"),
        F.lit(FALLBACK),
    )
    table, column = F.col("table_name"), F.col("column_name")
    kind = semantic_type(column, _optional(raw, "data_type"), _optional(raw, "is_primary_key", "boolean"))

    def flag(name):
        return F.coalesce(_optional(raw, name, "boolean"), F.lit(False)).alias(name)

    return df.select(
        column_doc_id(schema, table, column).alias("doc_id"),
        F.concat_ws("::", F.lit("table"), schema, table).alias("table_id"),
        *_head(),
        F.coalesce("_owner.source", F.lit(FALLBACK)).alias("datasource_id"),
        schema.alias("database_name"),
        schema.alias("schema_name"),
        table,
        column,
        F.concat_ws(".", schema, table, column).alias("full_column_name"),
        _or(raw, "column_comment").alias("business_name"),
        F.array(column).alias("aliases"),
        _or(raw, "data_type").alias("data_type"),
        kind.alias("semantic_type"),
        metric_role(kind).alias("metric_role"),
        flag("is_primary_key"),
        flag("is_foreign_key"),
        flag("is_nullable"),
        F.lit(False).alias("is_partition_key"),
        (kind == "TIME").alias("is_time_column"),
        F.lit("").alias("time_granularity"),
        normalize_json(_optional(raw, "enum_values")).cast("string").alias("enum_values"),
        _no_items().alias("sample_values"),
        F.lit("").alias("unit"),
        _no_items().alias("aggregation_hints"),
        _no_items().alias("join_hints"),
        F.coalesce(_optional(raw, "business_meaning"), _optional(raw, "column_comment"), F.lit("")).alias(
            "column_desc"
        ),
        F.lit(SECURITY).alias("security_level"),
        F.lit(True).alias("is_queryable"),
        F.lit(True).alias("is_active"),
        search_text(
            _optional(raw, "text"),
            column,
            _optional(raw, "column_comment"),
            _optional(raw, "business_meaning"),
            _optional(raw, "metric_type"),
            _optional(raw, "enum_values"),
        ).alias("search_text"),
        F.col("_payload").alias("payload"),
        _now(updated_at).alias("updated_at"),
    )


# Template defaults other than the empty text, list or map.
TEMPLATE_DEFAULTS = FIXED | {"risk_level": "MEDIUM", "version_name": "v1"}


def _spaced_list(items):
    """A list as JSON with a blank after each comma."""
    quoted = F.transform(
        items, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def build_template_catalog(raw: DataFrame, updated_at: int | None = None) -> DataFrame:
    """Templates with defaults filled in for what is absent or null."""
    from metaquarry.schemas import TEMPLATES

    lists = {
        f.name: F.coalesce(_optional(raw, f.name, f.dataType.simpleString()), _no_items())
        for f in TEMPLATES.schema.fields
        if f.dataType.simpleString() == "array<string>"
    }

    def column(f):
        kind = f.dataType.simpleString()
        if f.name in lists:
            return lists[f.name]
        value = _optional(raw, f.name, kind)
        if kind.startswith("map"):
            return F.coalesce(value, F.create_map().cast(f.dataType))
        if kind == "boolean":
            return F.coalesce(value, F.lit(True))
        if kind == "string":
            return F.coalesce(value, F.lit(TEMPLATE_DEFAULTS.get(f.name, "")))
        return value

    own = {
        "schema_version": F.coalesce(_optional(raw, "schema_version", "bigint"), F.lit(SCHEMA_VERSION)),
        "search_text": search_text(
            _optional(raw, "template_name"),
            _optional(raw, "template_type"),
            _optional(raw, "template_desc"),
            *[_spaced_list(lists[n]) for n in ("required_slots", "source_types", "target_types")],
        ),
        "payload": F.to_json(F.struct(*raw.columns)),
        "updated_at": _now(updated_at),
        "doc_id": F.col("doc_id"),
    }
    return raw.select(
        *[
            own.get(f.name, column(f)).alias(f.name)
            for f in TEMPLATES.schema.fields
            if f.name != "dense_vector"
        ]
    )


def with_vectors(catalog: DataFrame, dim: int = EMBEDDING_DIM, encode=None) -> DataFrame:
    """Add ``dense_vector`` of the search text; documents get no instruction prefix."""
    encode = encode or (lambda text: hash_embedding(text, dim))
    return catalog.withColumn("dense_vector", encode(F.col("search_text")))
