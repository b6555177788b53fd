"""Attribute filters as Columns, so they reach the Parquet scan."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a search in each kind of catalog may ask for, and what it always asks.
ASKABLE = {
    "table": ["tenant_id", "env", "datasource_id", "dialect", "business_domain"],
    "column": ["tenant_id", "env", "table_id"],
    "template": ["tenant_id", "env", "template_type", "business_domain"],
}
ALWAYS = {
    "table": {"status": "ACTIVE", "is_active": True},
    "column": {"status": "ACTIVE", "is_active": True, "is_queryable": True},
    "template": {"status": "ACTIVE", "is_active": True},
}


def conditions(filters: dict[str, Any] | None) -> dict[str, list]:
    """The values each attribute may have; attributes without any known value drop out."""
    known = {}
    for name, wanted in (filters or {}).items():
        several = isinstance(wanted, list | tuple | set | frozenset)
        known[name] = [value for value in (wanted if several else [wanted]) if value is not None]
    return {name: values for name, values in known.items() if values}


def build_filter(filters: dict[str, Any] | None) -> Column:
    """Every attribute has one of its values. A single value is an equality to Spark.

    Nulls ask for nothing: a null value, a null in a list, and a list without values.
    """
    return reduce(and_, [F.col(n).isin(values) for n, values in conditions(filters).items()], F.lit(True))


def catalog_filter(kind: str, **asked) -> dict[str, Any]:
    """Filters of a search in one kind of catalog."""
    unknown = set(asked) - set(ASKABLE[kind])
    if unknown:
        raise TypeError(f"a {kind} search cannot be filtered by {', '.join(sorted(unknown))}")
    return ALWAYS[kind] | asked


def table_filter(**asked) -> dict[str, Any]:
    return catalog_filter("table", **asked)


def column_filter(table_ids=None, **asked) -> dict[str, Any]:
    return catalog_filter("column", **asked, table_id=list(table_ids) if table_ids else None)


def template_filter(**asked) -> dict[str, Any]:
    return catalog_filter("template", **asked)


def active_tables(df: DataFrame, **filters) -> DataFrame:
    return df.where(build_filter(table_filter(**filters)))


def active_columns(df: DataFrame, table_ids: DataFrame | list | None = None, **filters):
    """Queryable live columns. ``table_ids`` may be a list, or a DataFrame of ``table_id``
    for id sets too large for a predicate."""
    if isinstance(table_ids, DataFrame):
        df = df.join(table_ids.select("table_id"), "table_id", "left_semi")
        table_ids = None
    return df.where(build_filter(column_filter(table_ids=table_ids, **filters)))


def active_templates(df: DataFrame, **filters) -> DataFrame:
    return df.where(build_filter(template_filter(**filters)))
