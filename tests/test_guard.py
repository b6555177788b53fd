import pytest
from pyspark.sql import functions as F

from metaquarry.functions import guard as g
from metaquarry.operators.audit import audit_report, gate

CASES = [
    ("SELECT * FROM users", True),
    ("WITH x AS (SELECT 1) SELECT * FROM x", True),
    ("select 1", True),
    ("DELETE FROM users", False),
    ("UPDATE users SET a = 1", False),
    ("INSERT INTO users VALUES (1)", False),
    ("SELECT 1; SELECT 2", False),
    ("SELECT 1 -- drop", False),
    ("SELECT 1 -- drop\n", True),
    ("SELECT ';' a", False),
    ("SELECT /* DELETE */ 1", True),
    ("SELECT /* a\nDROP */ 1", True),
    ("SELECTX", True),
    ("SELECT 'please update' x", False),
    ("SELECT last_update FROM t", True),
    ("SELECT 1 ; ", True),
    ("", False),
    ("  \n ", False),
    (";;", False),
    ("SELECT 1;\u3000", True),
    ("SELECT 1;\u00a0\u2003", True),
    ("\u3000SELECT 1", True),
    (None, False),
]


def test_is_safe_sql(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    got = {r.i: r.safe for r in rows.select("i", g.is_safe_sql(F.col("s")).alias("safe")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize(
    "flag,sql,start",
    [
        (True, "DELETE FROM users", "检测到"),
        (False, "SELECT 1", "检测到"),
        (True, "SELECT 1", "```sql\nSELECT 1\n```"),
    ],
)
def test_gate_message(spark, flag, sql, start):
    df = spark.createDataFrame([(flag, sql, "because")], "is_safe boolean, sql string, explanation string")
    row = gate(df).first()
    assert row.final_output.startswith(start)
    assert row.final_output.endswith("because")
    assert row.blocked == start.startswith("检测到")


def test_audit_report_counts_each_keyword(spark):
    df = spark.createDataFrame(
        [(True, "DROP TABLE a"), (True, "DROP TABLE a"), (False, "SELECT 1"), (True, "SELECT 1 MERGE DROP")],
        "is_safe boolean, sql string",
    ).withColumn("explanation", F.lit(""))
    got = {(r.reason, r.keyword): (r.n, r.n_distinct) for r in audit_report(gate(df)).collect()}
    assert got[("denied_keyword", "DROP")] == (3, 2)
    assert got[("denied_keyword", "MERGE")] == (1, 1)
    assert got[("not_read_only", None)] == (2, 1)
    assert got[("model_flag", None)] == (1, 1)
