"""Two-stage retrieval (parents, then their children) and rendering into prompt context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.operators.filters import column_filter, table_filter, template_filter
from metaquarry.operators.hybrid import Space, hybrid_search, with_fields
from metaquarry.operators.topk import SMALL_ROWS, fits, maybe_broadcast
from metaquarry.schemas import QUERY_INSTRUCTION
from metaquarry.session import cut_lineage

# How many hits each search returns and how many columns are rendered.
TABLE_HITS, COLUMN_HITS, TEMPLATE_HITS = 5, 10, 3
CONTEXT_TABLES, CONTEXT_COLUMNS, COLUMNS_PER_TABLE = 4, 12, 8


def ask(queries: DataFrame, encode, instruction: str = QUERY_INSTRUCTION) -> DataFrame:
    """Add ``query_vector``: the question's vector, encoded behind the instruction for questions."""
    return queries.withColumn("query_vector", encode(F.col("query_text"), instruction=instruction))


def search_tables(queries: DataFrame, space: Space, k: int = TABLE_HITS, **filters) -> DataFrame:
    return hybrid_search(queries, space, k, filters=table_filter(**filters))


def search_columns(
    queries: DataFrame, space: Space, k: int = COLUMN_HITS, allowed: DataFrame | None = None, **filters
) -> DataFrame:
    """``allowed`` (query_id, parent) restricts each query to columns of its own tables."""
    return hybrid_search(queries, space, k, filters=column_filter(**filters), allowed=allowed)


def search_templates(queries: DataFrame, space: Space, k: int = TEMPLATE_HITS, **filters) -> DataFrame:
    return hybrid_search(queries, space, k, filters=template_filter(**filters))


def _stored(hits: DataFrame) -> DataFrame:
    """Compute and store hits once; mark them for broadcast if they are few."""
    hits = cut_lineage(hits)
    return maybe_broadcast(hits, fits(hits))


def search_sql_context(
    queries: DataFrame,
    parents: Space,
    children: Space,
    parent_k: int = CONTEXT_TABLES,
    child_k: int = CONTEXT_COLUMNS,
    parent_filters: dict | None = None,
    child_filters: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Top parents per query, then top children among them: (parent hits, child hits).

    Children are restricted before they are ranked. A query whose parents gave no child
    is searched again without the restriction; only those queries are. Child hits carry
    their parent in ``children.parent_col``.
    """
    # both stages are read several times below, so each is computed once and stored
    first = _stored(hybrid_search(queries, parents, parent_k, filters=parent_filters))
    key = children.parent_col
    allowed = first.select("query_id", F.col(parents.id_col).alias(key))
    within = _stored(
        hybrid_search(queries, children, child_k, filters=child_filters, allowed=allowed)
    )
    unmet = queries.join(within.select("query_id").distinct(), "query_id", "left_anti")
    everywhere = hybrid_search(unmet, children, child_k, filters=child_filters)
    hits = with_fields(within, children, [key])
    hits = hits.unionByName(with_fields(everywhere, children, [key]))
    # a union forgets that its parts are few
    return first, maybe_broadcast(hits, fits(queries.select("query_id"), SMALL_ROWS // child_k))


def search_schemas(queries, parents: Space, children: Space, k: int = 5, **filters) -> DataFrame:
    """Parents with their found children nested in rank order; never more than four."""
    first, second = search_sql_context(
        queries, parents, children, min(max(k, 1), 4), max(2 * k, 6), **filters
    )
    key = children.parent_col
    nested = second.groupBy("query_id", key).agg(
        F.array_sort(
            F.collect_list(F.struct("rk", F.col(children.id_col).alias("child_id"), "score"))
        ).alias("children")
    )
    hits = first.where(F.col("rk") <= k).withColumn(key, F.col(parents.id_col))
    return hits.join(nested, ["query_id", key], "left").select(
        "query_id",
        parents.id_col,
        "score",
        "rk",
        F.coalesce("children", F.array().cast(nested.schema["children"].dataType)).alias("children"),
    )


def coverage(queries: DataFrame, **found: DataFrame) -> DataFrame:
    """Per query, whether each named kind of hit exists, and whether all do."""
    flags = [
        hits.select("query_id", F.lit(name).alias("_kind")) for name, hits in found.items()
    ]
    counts = (
        reduce(DataFrame.unionByName, flags)
        .groupBy("query_id")
        .agg(*[F.count_if(F.col("_kind") == name).alias(f"n_{name}") for name in found])
    )
    out = queries.select("query_id").join(counts, "query_id", "left")
    has = [(F.coalesce(F.col(f"n_{n}"), F.lit(0)) > 0).alias(f"has_{n}") for n in found]
    return out.select("query_id", *has).withColumn(
        "covered", reduce(lambda a, b: a & b, [F.col(f"has_{n}") for n in found])
    )


def columns_per_table(
    table_hits: DataFrame, column_hits: DataFrame, table_id: str, parent: str, cap: int = COLUMNS_PER_TABLE
) -> DataFrame:
    """The first ``cap`` column hits of each table hit; columns of other tables drop out."""
    kept = column_hits.join(
        table_hits.select("query_id", F.col(table_id).alias(parent)), ["query_id", parent], "left_semi"
    )
    w = Window.partitionBy("query_id", parent).orderBy("rk")
    return kept.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= cap)


def _text(name: str, have: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")


def json_items(name: str, have: list[str]) -> Column:
    """A list column as JSON text with a blank after each comma; missing is the empty list."""
    if name not in have:
        return F.lit("[]")
    quoted = F.transform(
        F.col(name), lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    )
    return F.coalesce(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), F.lit("[]"))


# Labels of the rendered blocks and the fields they show.
TABLE_BLOCK = {
    "Type": "table_type",
    "Dialect": "dialect",
    "Business Name": "business_name",
    "Business Domain": "business_domain",
    "Description": "table_desc",
    "Grain": "grain_desc",
}
TABLE_BLOCK_LISTS = {
    "Primary Keys": "primary_keys",
    "Partition Keys": "partition_keys",
    "Time Columns": "time_columns",
    "Join Hints": "join_hints",
}
TEMPLATE_BLOCK = {
    "Code": "template_code",
    "Name": "template_name",
    "Type": "template_type",
    "Domain": "business_domain",
}


def column_line(have: list[str]) -> Column:
    name = F.coalesce(F.nullif(_text("full_column_name", have), F.lit("")), _text("column_name", have))
    return F.concat(
        F.lit("  - "),
        name,
        F.lit(" | type="),
        _text("data_type", have),
        F.lit(" | semantic="),
        _text("semantic_type", have),
        F.lit(" | metric="),
        _text("metric_role", have),
        F.lit(" | desc="),
        _text("column_desc", have),
    )


def ordered_join(order: str, line: str, separator: str) -> Column:
    """Aggregate the lines of a (bounded) group to one text, in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order, line)))
    return F.array_join(F.transform(rows, lambda r: r[line]), separator)


def render_schema_context(table_hits: DataFrame, column_hits: DataFrame, table_id: str, parent: str):
    """One text per query: a labelled block per table, its columns listed below.

    ``table_hits`` and ``column_hits`` are hits with their fields joined. Groups hold at
    most the retrieval limits, so collecting them is bounded.
    """
    t, c = table_hits.columns, column_hits.columns
    lines = (
        columns_per_table(table_hits, column_hits, table_id, parent)
        .withColumn("_line", column_line(c))
        .groupBy("query_id", parent)
        .agg(ordered_join("slot", "_line", "\n").alias("_columns"))
    )
    full = F.coalesce(F.nullif(_text("full_table_name", t), F.lit("")), _text("table_name", t))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Table: "), full),
        *[F.concat(F.lit(f"{label}: "), _text(n, t)) for label, n in TABLE_BLOCK.items()],
        *[F.concat(F.lit(f"{label}: "), json_items(n, t)) for label, n in TABLE_BLOCK_LISTS.items()],
        F.concat(F.lit("Columns:\n"), F.col("_columns")),
    )
    return (
        table_hits.withColumn(parent, F.col(table_id))
        .join(lines, ["query_id", parent], "left")
        .select("query_id", "rk", block.alias("_block"))
        .groupBy("query_id")
        .agg(ordered_join("rk", "_block", "\n\n").alias("context"))
    )


def _json_of(df: DataFrame, names: list[str], empty: str) -> Column:
    """The first of the columns that is there, as JSON; text columns hold JSON already."""
    cols = [
        F.col(n) if df.schema[n].dataType.simpleString() == "string" else F.to_json(F.col(n))
        for n in names
        if n in df.columns
    ]
    return F.coalesce(*cols, F.lit(empty))


def render_templates(hits: DataFrame) -> DataFrame:
    """One text per query: a numbered block per template hit, in rank order."""
    have = hits.columns
    desc = F.coalesce(
        *[F.col(n) for n in ("template_desc", "content") if n in have], F.lit("")
    )
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[Template "), F.col("rk").cast("string"), F.lit("]")),
        *[F.concat(F.lit(f"{label}: "), _text(n, have)) for label, n in TEMPLATE_BLOCK.items()],
        F.concat(F.lit("Description: "), desc),
        F.concat(F.lit("Required Slots: "), json_items("required_slots", have)),
        F.concat(F.lit("Optional Slots: "), json_items("optional_slots", have)),
        F.concat(F.lit("Slot Schema: "), _json_of(hits, ["slot_schema"], "{}")),
        F.concat(F.lit("Compatibility: "), _json_of(hits, ["compatibility_rules"], "{}")),
        F.concat(F.lit("Default Payload: "), _json_of(hits, ["default_payload", "payload"], "{}")),
    )
    rows = hits.select("query_id", "rk", block.alias("_block"))
    return rows.groupBy("query_id").agg(ordered_join("rk", "_block", "\n\n").alias("context"))


def intent_options(intents: DataFrame) -> DataFrame:
    """A bullet per intent in registry order, as one text.

    ``intents`` is a registry (ord, name, description): as many rows as a prompt can list.
    """
    line = F.concat(F.lit("- "), "name", F.lit(": "), "description")
    return intents.select("ord", line.alias("_line")).agg(
        ordered_join("ord", "_line", "\n").alias("options")
    )


def few_shot(examples: DataFrame, n: int = 3, order: str = "ord") -> DataFrame:
    """The first n examples of each intent as one text per intent.

    ``examples`` (name, ord, example) may be large: it is cut to n rows per intent before
    anything is collected.
    """
    w = Window.partitionBy("name").orderBy(order)
    first = examples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    line = F.concat(F.lit("User: "), "example", F.lit("\nIntent: "), "name")
    return (
        first.select("name", "_n", line.alias("_line"))
        .groupBy("name")
        .agg(ordered_join("_n", "_line", "\n").alias("shots"))
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def assemble_prompt(turns: DataFrame, system: Column, summary_label: str) -> DataFrame:
    """Messages for the model, in order: instructions, summary, history, user input.

    ``turns`` has summary, history (array of role and content) and input.
    """
    empty = F.array().cast("array<struct<role:string,content:string>>")
    prompt = F.concat(
        F.array(message("system", system)),
        F.array(message("system", F.concat(F.lit(summary_label), F.coalesce("summary", F.lit(""))))),
        F.coalesce("history", empty),
        F.array(message("user", F.col("input"))),
    )
    return turns.withColumn("prompt", prompt)


def render_prompt(prompt: Column) -> Column:
    return F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
