"""The strict lexer, and sketches that are stored and united."""

from pyspark.sql import functions as F

from metaquarry.functions import guard as g
from metaquarry.operators.audit import SKETCH_ERROR, audit_sketches, united_report

CASES = {
    "SELECT 1": True,
    "SELECT ';' AS a": True,
    "SELECT 'please drop' FROM t": True,
    "SELECT 'it''s; delete' x": True,
    "SELECT '''; DROP' x": True,
    "SELECT 'a'; DROP TABLE t": False,
    "SELECT 'a' || '; DROP TABLE t": False,  # open
    'SELECT "drop", `update` FROM "a;b"': True,
    'SELECT "a""; drop" FROM t': True,
    'SELECT "a': False,
    "SELECT 1 -- drop": True,
    "SELECT 1 -- it's\n; DELETE FROM t": False,
    "SELECT 1 /* a /* nested */ DROP */ , 2": True,
    "SELECT 1 /* a /* nested */ , 2": False,  # one level is open
    "SELECT 1 */ 2": True,
    "/* x */ WITH a AS (SELECT 1) SELECT * FROM a;": True,
    "WITH a AS (SELECT 1) DELETE FROM a": False,
    "SELECTX": False,
    "SELECT": True,
    "-- SELECT 1": False,
    "'SELECT 1'": False,
    "": False,
    " ; ; ": False,
    "SELECT 1;;": True,
    "SELECT/**/1": True,
    "DE/**/LETE FROM t": False,
}


def test_strict(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)] + [(99, None)], "i long, s string")
    got = {r["i"]: r["safe"] for r in df.select("i", g.is_safe_sql_strict(F.col("s")).alias("safe")).collect()}
    assert {s: got[i] for i, s in enumerate(CASES)} == CASES and got[99] is False


def test_lexed(spark):
    df = spark.createDataFrame([("a 'b' /* c */ \"d\" -- e\nf",), ("x /* y",)], "s string")
    got = [tuple(r["l"]) for r in df.select(g.lexed(F.col("s")).alias("l")).collect()]
    assert got == [("a ''    x   f", ""), ("x ", "block")]


def test_many_tokens(spark):
    df = spark.createDataFrame([("SELECT " + "'a', " * 5_000 + "1",)], "s string")
    assert df.select(g.is_safe_sql_strict(F.col("s")).alias("safe")).first()["safe"]


def test_united_sketches(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 7).alias("day"),
        F.concat(F.lit("q"), F.col("id") % 9_000).alias("sql"),
        F.lit(True).alias("blocked"),
        F.array(F.lit("denied_keyword"), F.lit("model_flag")).alias("block_reasons"),
        F.array(F.lit("DROP"), F.lit("CALL")).alias("denied"),
    )
    got = {(r["reason"], r["keyword"]): r for r in united_report(audit_sketches(rows, "day")).collect()}
    assert set(got) == {("denied_keyword", "DROP"), ("denied_keyword", "CALL"), ("model_flag", None)}
    for r in got.values():
        assert r["n"] == 30_000 and abs(r["n_distinct"] - 9_000) <= 3 * SKETCH_ERROR * 9_000
