"""Task slot filling as table operators over template rules.

Template columns: required_slots, slot_schema, compatibility_rules, default_payload,
payload_schema, render_rules. ``collected`` is a map of slot to value.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.functions.text import parse_json

COLLECTING, READY = "collecting", "ready"
# The reply texts.
NEED_OPEN, NEED_CLOSE = "为了为您构建任务，我还需要以下信息：", "。\n\n"
DONE_OPEN, DONE_CLOSE = "任务配置已生成：\n```json\n", "\n```\n\n说明: "

_NO_PARAMS = "map<string,string>"


def _params(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast(_NO_PARAMS))


def select_template(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Per thread, the stored template while it is collecting, else the best hit.

    ``hits``: thread_id, rk, template_code. ``state``: thread_id, template_code, status.
    """
    stored = state.select("thread_id", F.col("template_code").alias("_stored"), "status")
    best = hits.where("rk = 1").select("thread_id", F.col("template_code").alias("_best"))
    resumed = F.coalesce(F.col("status") == COLLECTING, F.lit(False))
    return best.join(stored, "thread_id", "full_outer").select(
        "thread_id",
        F.when(resumed, F.col("_stored")).otherwise(F.col("_best")).alias("template_code"),
        resumed.alias("resumed"),
    )


def merge_params(old: Column, new: Column) -> Column:
    """Both maps; the new value of a slot wins."""
    old, new = _params(old), _params(new)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def carry_params(active: Column, status: Column, carry_over: bool = True) -> Column:
    """What a new turn starts from. By default parameters of a finished task carry over."""
    return _params(active) if carry_over else F.when(status == COLLECTING, _params(active))


def latest_params(log: DataFrame, thread: str, slot: str, value: str, order: list[str]) -> DataFrame:
    """The merge of a whole parameter log: last value per slot, as one map per thread.

    The values of a slot are reduced before the shuffle; the map holds one entry per slot.
    """
    last = log.groupBy(thread, slot).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return last.groupBy(thread).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(slot, "_v")))).alias("collected")
    )


def missing_params(required: Column, collected: Column, rules: Column | None = None) -> Column:
    """Required slots without a value, in template order, and those the chosen target needs."""
    have = F.map_keys(_params(collected))
    need = required
    if rules is not None:
        extra = F.element_at(rules["target_type_requires"], F.element_at(_params(collected), F.lit("target_type")))
        need = F.concat(required, F.coalesce(extra, F.array().cast("array<string>")))
    return F.array_except(need, have)


def task_status(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, COLLECTING).otherwise(READY)


def payload_values(render_rules: Column, default_payload: Column, collected: Column) -> Column:
    """Flat payload: path to value. A slot that was not collected leaves its path out, or
    leaves the default of that path standing."""
    have = _params(collected)
    filled = F.map_filter(
        F.transform_values(render_rules, lambda _, ref: F.element_at(have, F.ltrim(ref, F.lit("$")))),
        lambda _, v: v.isNotNull(),
    )
    return merge_params(default_payload, filled)


def payload_types(render_rules: Column, slot_schema: Column, payload_schema: Column) -> Column:
    """Path to JSON type: that of the slot that fills it, else that of the payload schema."""
    of_slot = F.transform_values(
        render_rules, lambda _, ref: F.element_at(slot_schema, F.ltrim(ref, F.lit("$")))["type"]
    )
    of_slot = F.map_filter(of_slot, lambda _, v: v.isNotNull())
    return merge_params(F.transform_values(payload_schema["properties"], lambda _, v: v["type"]), of_slot)


# JSON texts of the types that are not written in quotes.
_LITERALS = {
    "integer": r"^-?(0|[1-9][0-9]*)$",
    "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
    "null": r"^null$",
}


def json_value(value: Column, kind: Column) -> Column:
    """JSON text of a value of a type. A value that is not of its type is written as a string."""
    quoted = F.to_json(F.array(value))
    plain = (kind.isin("object", "array")) & F.try_parse_json(value).isNotNull()
    for name, pattern in _LITERALS.items():
        plain = plain | ((kind == name) & value.rlike(pattern))
    return F.when(F.coalesce(plain, F.lit(False)), value).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )


def nested_json(flat: Column, indent: int | None = None) -> Column:
    """JSON text of a map of path to JSON text; ``a.b.c`` paths become objects of any depth.

    Keys are sorted. A path below another path that has a value is left out. With ``indent``
    every member has a line of its own.
    """
    entries = F.map_entries(flat)
    kept = F.filter(
        entries, lambda e: ~F.exists(entries, lambda o: F.startswith(e["key"], F.concat(o["key"], F.lit("."))))
    )
    rows = F.array_sort(
        F.transform(kept, lambda e: F.struct(F.split(e["key"], r"\.").alias("names"), e["value"].alias("value")))
    )

    def line(depth: Column) -> Column:
        return F.lit("") if indent is None else F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), depth))

    def closed(upto: Column, depth: Column) -> Column:
        """Closes the objects from ``depth`` down to ``upto``."""
        steps = F.when(depth > upto, F.reverse(F.sequence(upto + 1, depth))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(steps, lambda d: F.concat(line(d), F.lit("}"))), "")

    colon = F.lit('":' if indent is None else '": ')

    def add(state: Column, row: Column) -> Column:
        before, names = state["names"], row["names"]
        shared = F.size(
            F.filter(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(before), F.size(names)) - 1)),
                lambda i: (F.least(F.size(before), F.size(names)) > 1)
                & (F.slice(before, F.lit(1), i) == F.slice(names, F.lit(1), i)),
            )
        )
        depth = F.size(names) - 1
        opened = F.array_join(
            F.transform(
                F.slice(names, shared + 1, depth - shared),
                lambda n, i: F.concat(line(shared + i + 1), F.lit('"'), n, colon, F.lit("{")),
            ),
            "",
        )
        member = F.concat(line(depth + 1), F.lit('"'), F.element_at(names, -1), colon, row["value"])
        comma = F.when(F.size(before) > 0, F.lit(",")).otherwise(F.lit(""))
        text = F.concat(state["text"], closed(shared, F.size(before) - 1), comma, opened, member)
        return F.struct(names.alias("names"), text.alias("text"))

    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit("{").alias("text"))
    return F.aggregate(
        rows,
        start,
        add,
        lambda s: F.concat(
            s["text"],
            closed(F.lit(0), F.size(s["names"]) - 1),
            F.when(F.size(s["names"]) > 0, line(F.lit(0))).otherwise(F.lit("")),
            F.lit("}"),
        ),
    )


def render_payload(
    render_rules: Column,
    default_payload: Column,
    collected: Column,
    slot_schema: Column | None = None,
    payload_schema: Column | None = None,
    indent: int | None = None,
) -> Column:
    """The payload's JSON text. Types come from the schemas; what they do not name is a string."""
    types = F.create_map().cast(_NO_PARAMS)
    if slot_schema is not None and payload_schema is not None:
        types = payload_types(render_rules, slot_schema, payload_schema)
    flat = payload_values(render_rules, default_payload, collected)
    typed = F.transform_values(flat, lambda path, v: json_value(v, F.element_at(types, path)))
    return nested_json(typed, indent)


def payload_kinds(payload_json: Column) -> Column:
    """Top-level key to JSON type name of a payload text."""
    entries = parse_json(payload_json).cast("map<string,variant>")

    def kind(_, v):
        t = F.schema_of_variant(v)
        return (
            F.when(t == "STRING", "string")
            .when(t == "BIGINT", "integer")
            .when(t == "BOOLEAN", "boolean")
            .when(F.startswith(t, F.lit("OBJECT")), "object")
            .when(F.startswith(t, F.lit("ARRAY")), "array")
            .when(t == "VOID", "null")
            .otherwise("number")
        )

    return F.transform_values(entries, kind)


def payload_errors(payload_json: Column, payload_schema: Column) -> Column:
    """``missing:key`` per absent required key, ``type:key`` per value of another type."""
    kinds = payload_kinds(payload_json)
    types = payload_schema["properties"]
    absent = F.array_except(payload_schema["required"], F.map_keys(kinds))
    wrong = F.filter(
        F.array_sort(F.map_keys(kinds)),
        lambda k: F.coalesce(F.element_at(types, k)["type"] != F.element_at(kinds, k), F.lit(False)),
    )
    return F.concat(
        F.transform(absent, lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(wrong, lambda k: F.concat(F.lit("type:"), k)),
    )


def slot_errors(collected: Column, slot_schema: Column) -> Column:
    """``type:slot`` for an integer slot without an integer, ``enum:slot`` for a value that
    is not listed. Slots the template does not know are not judged."""
    have = _params(collected)

    def bad_type(k):
        rule = F.element_at(slot_schema, k)["type"]
        return (rule == "integer") & ~F.element_at(have, k).rlike(r"^-?[0-9]+$")

    def bad_enum(k):
        return ~F.array_contains(F.element_at(slot_schema, k)["enum"], F.element_at(have, k))

    keys = F.array_sort(F.map_keys(have))
    return F.concat(
        F.transform(
            F.filter(keys, lambda k: F.coalesce(bad_type(k), F.lit(False))),
            lambda k: F.concat(F.lit("type:"), k),
        ),
        F.transform(
            F.filter(keys, lambda k: F.coalesce(bad_enum(k), F.lit(False))),
            lambda k: F.concat(F.lit("enum:"), k),
        ),
    )


def compatible_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates that can serve a request (source_type, target_type, mode).

    Rules are unfolded to (source, target) pairs and matched by an equi-join. A template
    without listed types in its rules serves those of its own type columns. INCREMENTAL
    needs the template to support it.
    """
    rules = F.col("compatibility_rules")
    pairs = (
        templates.select(
            "template_code",
            F.coalesce(rules["supports_incremental"], F.lit(False)).alias("_incremental"),
            F.coalesce(rules["target_types"], F.col("target_types")).alias("_targets"),
            F.explode(F.coalesce(rules["source_types"], F.col("source_types"))).alias("source_type"),
        )
        .withColumn("target_type", F.explode("_targets"))
        .drop("_targets")
    )
    fits = (F.col("mode") != "INCREMENTAL") | F.col("_incremental")
    return requests.join(pairs, ["source_type", "target_type"]).where(fits).drop("_incremental")


def task_message(missing: Column, task_json: Column, explanation: Column) -> Column:
    """Ask for what is missing, or show the finished configuration."""
    why = F.coalesce(explanation, F.lit(""))
    ask = F.concat(F.lit(NEED_OPEN), F.array_join(missing, ", "), F.lit(NEED_CLOSE), why)
    done = F.concat(F.lit(DONE_OPEN), F.coalesce(task_json, F.lit("null")), F.lit(DONE_CLOSE), why)
    return F.when(F.size(missing) > 0, ask).otherwise(done)


def pretty_json(json_text: Column) -> Column:
    """Foreign JSON text indented by two blanks, other scripts kept as they are; null where
    it is no JSON. A payload of our own is written indented by ``render_payload``."""

    def written(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except ValueError:
            return None

    @F.pandas_udf(T.StringType())
    def indent(texts: pd.Series) -> pd.Series:
        return texts.map(written)

    return indent(json_text)


def advance_tasks(state: DataFrame, extracted: DataFrame, templates: DataFrame) -> DataFrame:
    """One turn for many threads: merge, list what is missing, set status.

    ``state``: thread_id, collected. ``extracted``: thread_id, template_code, params.
    """
    return (
        extracted.join(state.select("thread_id", F.col("collected").alias("_old")), "thread_id", "left")
        .withColumn("collected", merge_params(F.col("_old"), F.col("params")))
        .join(templates, "template_code")
        .withColumn(
            "missing",
            missing_params(F.col("required_slots"), F.col("collected"), F.col("compatibility_rules")),
        )
        .withColumn("status", task_status(F.col("missing")))
        .select("thread_id", "template_code", "collected", "missing", "status")
    )
