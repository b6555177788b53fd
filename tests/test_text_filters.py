from pyspark.sql import functions as F

from metaquarry.functions import text as tx
from metaquarry.operators.catalogs import build_column_catalog, build_table_catalog
from metaquarry.operators.filters import active_columns, build_filter, column_filter


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokens(spark):
    assert one(spark, tx.tokens(F.lit("Ab_1, Éé—x"))) == ["ab_1", "éé", "x"]
    pairs = one(spark, tx.tokens(F.lit("查询订单 a"), han_pairs=True))
    assert pairs == ["查询订单", "a", "查询", "询订", "订单"]


def test_search_text_keeps_separators(spark):
    c = tx.search_text(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit(""))
    assert one(spark, c) == "a\n\nb"
    assert one(spark, tx.search_text(F.lit("\n\t x \r\n"), F.lit(""))) == "x"


def test_semantic_type_order(spark):
    rows = [
        ("id", "datetime", True, "ID"),
        ("created_at", "bigint", False, "TIME"),
        ("a", "timestamp", False, "TIME"),
        ("b", "UPDATE_INT", False, "TIME"),
        ("c", "decimal(18,2)", None, "METRIC"),
        ("d", "varchar(255)", False, "DIMENSION"),
        ("points", "POINT", False, "METRIC"),
    ]
    df = spark.createDataFrame(rows, "n string, t string, pk boolean, want string")
    got = df.select("want", tx.semantic_type(F.col("n"), F.col("t"), F.col("pk")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_normalize_json(spark):
    rows = ["12", "true", "null", '{"a": 1}', "NaN", "plain", "", '{"a":1} x', "1,2", "1] x", "1} x", '"q"']
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    v = tx.normalize_json(F.col("s"))
    got = {r.s: (r.k, r.v) for r in df.select("s", F.schema_of_variant(v).alias("k"), v.cast("string").alias("v")).collect()}
    assert got["12"][0] == "BIGINT" and got["true"][0] == "BOOLEAN" and got["null"][0] == "VOID"
    assert got['{"a": 1}'][0].startswith("OBJECT")
    assert got['"q"'] == ("STRING", "q")
    for raw in ("NaN", "plain", "", '{"a":1} x', "1,2", "1] x", "1} x"):
        assert got[raw] == ("STRING", raw)


def test_build_filter(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", False)], "i int, s string, f boolean")

    def ids(filters):
        return sorted(r.i for r in df.where(build_filter(filters)).collect())

    assert ids({}) == ids(None) == ids({"s": None}) == ids({"s": []}) == ids({"s": [None]}) == [1, 2, 3]
    assert ids({"s": "a", "f": True}) == [1]
    assert ids({"s": ["a", None, "b"], "i": (2, 3)}) == [2, 3]
    assert column_filter(table_ids=[])["table_id"] is None


def test_column_catalog_takes_last_table_of_a_name(spark):
    tables = spark.createDataFrame(
        [(1, "t", "old", "s1"), (2, "t", "", "s2")], "table_no int, table_name string, schema_name string, data_source string"
    )
    cols = spark.createDataFrame(
        [("t", "c", None, "int"), ("t", "d", "own", "date"), ("u", "e", "", "x")],
        "table_name string, column_name string, schema_name string, data_type string",
    )
    got = {r.column_name: r for r in build_column_catalog(cols, tables, 0).collect()}
    assert got["c"].table_id == "table::default::t" and got["c"].datasource_id == "s2"
    assert got["d"].doc_id == "column::own::t::d" and got["d"].is_time_column
    assert got["e"].schema_name == "default" and got["e"].datasource_id == "default"
    assert got["c"].is_primary_key is False and got["c"].column_desc == ""


def test_table_id_falls_back_to_database_but_full_name_does_not(spark):
    raw = spark.createDataFrame([("t", "", "db")], "table_name string, schema_name string, database_name string")
    row = build_table_catalog(raw, 0).first()
    assert row.doc_id == "table::db::t"
    assert row.full_table_name == "default.t"


def test_active_columns_by_id_table(spark):
    df = spark.createDataFrame(
        [("a", "ACTIVE", True, True), ("b", "ACTIVE", True, True), ("a", "ACTIVE", True, False), ("a", "OLD", True, True)],
        "table_id string, status string, is_active boolean, is_queryable boolean",
    )
    ids = spark.createDataFrame([("a",)], "table_id string")
    assert active_columns(df, ids).count() == 1
    assert active_columns(df, ["a"]).count() == 1
    assert active_columns(df).count() == active_columns(df, []).count() == 2


def test_strip_looks_at_the_ends_only(spark):
    from metaquarry.functions.text import BLANKS, strip

    texts = ["", " ", " a b\t", "　a  b  \u0085\r\n", "a\n", "\x1c\x1f​ a", None, "  ", "名 前 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    by_pattern = F.regexp_replace("t", rf"^{BLANKS}+|{BLANKS}+$", "")
    out = rows.select(strip(F.col("t")).alias("a"), by_pattern.alias("b"))
    assert "regexp" not in rows.select(strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.a == r.b for r in out.collect())
    every = spark.range(0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("t"))
    text = F.concat("t", F.lit("x"), "t")
    differ = every.where(strip(text) != F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", ""))
    assert differ.count() == 0
