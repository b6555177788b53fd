"""Column expressions for text: tokens, search text, ids, semantic types, descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN, TOKEN_GAPS = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]++"
HAN_PAIR_PATTERN = r"(?=(\p{IsHan}\p{IsHan}))"


def tokens(text: Column, han_pairs: bool = False) -> Column:
    """Lower-cased letter/digit runs; optionally every overlapping pair of Han characters too."""
    low = F.lower(text)
    # cutting at the gaps is faster than collecting the matches
    words = F.array_remove(F.split(low, TOKEN_GAPS), "")
    if not han_pairs:
        return words
    return F.concat(words, F.regexp_extract_all(low, F.lit(HAN_PAIR_PATTERN), F.lit(1)))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN_PATTERN))


# All Unicode white space, for patterns of Spark and of other engines alike.
BLANKS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


#: The same characters one by one.
BLANK_CHARS = "".join(
    chr(c)
    for low, high in ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                      (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    for c in range(low, high + 1)
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes blanks only).

    A pattern would be tried at every character of the text; this looks at the ends.
    """
    return F.btrim(text, F.lit(BLANK_CHARS))


def filled(c: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def search_text(*parts: Column) -> Column:
    """Parts joined by newlines; a missing part keeps its separator."""
    return strip(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def table_doc_id(schema_name: Column, database_name: Column, table_name: Column) -> Column:
    schema = first_filled(schema_name, database_name, F.lit("default"))
    return F.concat_ws("::", F.lit("table"), schema, table_name)


def column_doc_id(schema_name: Column, table_name: Column, column_name: Column) -> Column:
    return F.concat_ws("::", F.lit("column"), schema_name, table_name, column_name)


# Semantic types and the data-type fragments that decide them.
TIME_FRAGMENTS = ("time", "date")
NUMBER_FRAGMENTS = ("int", "decimal", "double", "float", "bigint")


def semantic_type(column_name: Column, data_type: Column, is_primary_key: Column) -> Column:
    dtype = F.lower(F.coalesce(data_type, F.lit("")))
    name = F.lower(F.coalesce(column_name, F.lit("")))

    def mentions(fragments):
        return reduce(lambda a, b: a | b, [F.contains(dtype, F.lit(x)) for x in fragments])

    return (
        F.when(F.coalesce(is_primary_key, F.lit(False)), "ID")
        .when(mentions(TIME_FRAGMENTS) | F.endswith(name, F.lit("_at")), "TIME")
        .when(mentions(NUMBER_FRAGMENTS), "METRIC")
        .otherwise("DIMENSION")
    )


def metric_role(semantic: Column) -> Column:
    return F.when(semantic == "METRIC", "SUMMABLE").otherwise("NON_AGG")


# Labels of the description texts.
TABLE_LABELS = {
    "table_name": "表名：",
    "schema_name": "数据库：",
    "business_domain": "业务域：",
    "data_source": "数据源：",
    "is_fact_table": "是否事实表：",
    "table_comment": "描述：",
}
COLUMN_LABELS = {
    "column_name": "字段名：",
    "table_name": "所属表：",
    "data_type": "数据类型：",
    "is_primary_key": "是否主键：",
    "is_foreign_key": "是否外键：",
    "is_nullable": "是否可空：",
    "business_meaning": "业务含义：",
    "metric_type": "指标类型：",
    "enum_values": "枚举值：",
}
YES, NO = "是", "否"


def describe(labels: dict[str, str]) -> Column:
    """One ``label value`` line per field, with a newline before the first and after the last."""
    lines = []
    for name, label in labels.items():
        value = F.col(name)
        if name.startswith("is_"):
            value = F.when(value, YES).otherwise(NO)
        lines.append(F.concat(F.lit(label), F.coalesce(value, F.lit(""))))
    return F.concat(F.lit("\n"), F.concat_ws("\n", *lines), F.lit("\n"))


def describe_table() -> Column:
    return describe(TABLE_LABELS)


def describe_column() -> Column:
    return describe(COLUMN_LABELS)


def parse_json(c: Column) -> Column:
    """VARIANT of a text that is JSON as a whole, else null.

    Spark's parser stops after the first value and ignores what follows. Inside an array
    and inside an object, text after the value is an error in at least one of the two.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def normalize_json(c: Column) -> Column:
    """VARIANT of the parsed value when the string is JSON, else of the string itself."""
    as_text = F.to_json(F.array(c))
    quoted = F.substring(as_text, F.lit(2), F.length(as_text) - 2)
    return F.coalesce(parse_json(c), F.try_parse_json(quoted))
