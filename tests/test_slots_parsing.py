from pyspark.sql import functions as F

from metaquarry.operators import parsing as ps
from metaquarry.operators import slots as sl

MAP = "map<string,string>"


def params(**kv):
    return F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.create_map().cast(MAP)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_merge_and_status(spark):
    assert one(spark, sl.merge_params(params(a="1", b="1"), params(b="2"))) == {"a": "1", "b": "2"}
    assert one(spark, sl.merge_params(F.lit(None).cast(MAP), params(b="2"))) == {"b": "2"}
    finished = sl.carry_params(params(a="1"), F.lit("ready"))
    assert one(spark, finished) == {"a": "1"}
    assert one(spark, sl.carry_params(params(a="1"), F.lit("ready"), carry_over=False)) is None
    assert one(spark, sl.task_status(F.array())) == "ready"
    assert one(spark, sl.task_status(F.array(F.lit("x")))) == "collecting"


def test_messages(spark):
    missing = F.array(F.lit("target_table"), F.lit("schedule"))
    text = one(spark, sl.task_message(missing, F.lit(None), F.lit("please")))
    assert "target_table, schedule" in text and text.endswith("please")
    done = one(spark, sl.task_message(F.array().cast("array<string>"), sl.pretty_json(F.lit('{"表": 1}')), F.lit("ok")))
    assert '```json\n{\n  "表": 1\n}\n```' in done


def test_missing_params_of_the_chosen_target(spark):
    df = spark.sql(
        """select array('sql', 'target_type') req,
          named_struct('target_type_requires', map('FILE', array('output_path'))) rules"""
    )
    got = df.select(
        sl.missing_params(F.col("req"), params(target_type="FILE"), F.col("rules")).alias("a"),
        sl.missing_params(F.col("req"), params(target_type="TABLE", sql="x"), F.col("rules")).alias("b"),
        sl.missing_params(F.col("req"), F.lit(None).cast(MAP)).alias("c"),
    ).first()
    assert (got.a, got.b, got.c) == (["sql", "output_path"], [], ["sql", "target_type"])


def test_payload(spark):
    rules = params(**{"source.table": "$t", "source.conn": "$c", "size": "$n", "note": "$absent"})
    slots = F.expr("map('n', named_struct('type', 'integer'), 't', named_struct('type', 'string'))")
    types = F.expr("named_struct('properties', map('mode', named_struct('type', 'string')))")
    filled = params(t='a"b', n="12345678901234567890")
    text = one(spark, sl.render_payload(rules, params(mode="7", size="5"), filled, slots, types))
    assert text == '{"mode":"7","size":12345678901234567890,"source":{"table":"a\\"b"}}'
    bad = one(spark, sl.render_payload(rules, params(mode="FULL"), params(n="x7"), slots, types))
    assert bad == '{"mode":"FULL","size":"x7"}'
    text = '{"mode":"FULL","size":7,"source":{"table":"t"}}'
    schema = F.expr(
        """named_struct('required', array('mode', 'target'), 'properties',
          map('mode', named_struct('type', 'string'), 'size', named_struct('type', 'string'),
              'source', named_struct('type', 'object')))"""
    )
    assert one(spark, sl.payload_errors(F.lit(text), schema)) == ["missing:target", "type:size"]


def test_nested_json_of_any_depth(spark):
    import json

    paths = {"a.b.c.d": 1, "a.b.c.e": 2, "a.b.f": 3, "a.g": 4, "b": 5, "a-x": 6, "c.d.e.f.g": 7, "c.d.h": 8, "b.no": 9}
    want = {
        "a": {"b": {"c": {"d": 1, "e": 2}, "f": 3}, "g": 4}, "b": 5, "a-x": 6,
        "c": {"d": {"e": {"f": {"g": 7}}, "h": 8}},
    }
    flat = params(**{k: str(v) for k, v in paths.items()})
    text = one(spark, sl.nested_json(flat))
    assert json.loads(text) == want and " " not in text
    assert one(spark, sl.nested_json(flat, 2)) == json.dumps(json.loads(text), indent=2)
    assert one(spark, sl.nested_json(F.create_map().cast("map<string,string>"), 2)) == "{}"


def test_malformed_json_does_not_fail(spark):
    assert one(spark, sl.pretty_json(F.lit("{x"))) is None


def test_slot_errors(spark):
    schema = F.expr(
        """map('n', named_struct('type', 'integer', 'description', '', 'enum', cast(null as array<string>)),
               'k', named_struct('type', 'string', 'description', '', 'enum', array('A', 'B')))"""
    )
    assert one(spark, sl.slot_errors(params(n="x", k="C", other="?"), schema)) == ["type:n", "enum:k"]
    assert one(spark, sl.slot_errors(params(n="-3", k="A"), schema)) == []


def test_select_template_resumes_only_while_collecting(spark):
    hits = spark.createDataFrame([(i, r, f"hit{r}") for i in (1, 2, 3) for r in (1, 2)], "thread_id long, rk int, template_code string")
    state = spark.createDataFrame([(1, "old", "collecting"), (2, "old", "ready")], "thread_id long, template_code string, status string")
    got = {r.thread_id: r.template_code for r in sl.select_template(hits, state).collect()}
    assert got == {1: "old", 2: "hit1", 3: "hit1"}


def test_advance_tasks(spark):
    templates = spark.sql(
        """select 'c' template_code, array('table', 'col') required_slots,
          named_struct('target_type_requires', cast(map() as map<string,array<string>>)) compatibility_rules"""
    )
    state = spark.sql("select 1L thread_id, map('table', 't0') collected")
    turn = spark.sql("select 1L thread_id, 'c' template_code, map('table', 't1') params union all select 2, 'c', map('table', 'x', 'col', 'y')")
    got = {r.thread_id: r for r in sl.advance_tasks(state, turn, templates).collect()}
    assert got[1].collected == {"table": "t1"} and got[1].missing == ["col"] and got[1].status == "collecting"
    assert got[2].status == "ready" and got[2].missing == []


def test_parse_route(spark):
    rows = [
        ('{"thought": "t", "category": "SQL_QUERY"}', "SQL_QUERY"),
        ('```json\n{"thought": "t", "category": "X"}\n```', "X"),
        ('{"thought": "t"}', "CHAT"),
        ('{"thought": "t", "category": 5}', "CHAT"),
        ('{"thought": "t", "category": "SQL_QUERY"} trailing', "CHAT"),
        ("nonsense", "CHAT"),
        (None, "CHAT"),
    ]
    df = spark.createDataFrame(rows, "response string, want string")
    assert all(r.intent == r.want for r in ps.parse_route(df).collect())


def test_parse_task_output_and_quarantine(spark):
    rows = [
        (1, '{"task_json": {"a": 1}, "extracted_params": {"t": "x"}, "missing_params": [], "explanation": "e"}'),
        (2, '{"task_json": null, "extracted_params": null, "missing_params": ["a"], "explanation": "e"}'),
        (3, '{"extracted_params": null, "missing_params": ["a"], "explanation": "e"}'),
        (4, "oops"),
    ]
    out = ps.parse_task_output(spark.createDataFrame(rows, "i int, response string"))
    good, bad, counts = ps.quarantine(out)
    got = {r.i: r for r in good.collect()}
    assert got[1].task_json == '{"a":1}' and got[1].extracted_params == {"t": "x"} and got[1].missing_params == []
    assert got[2].task_json is None and got[2].missing_params == ["a"]
    assert {r.i: r.reason for r in bad.collect()} == {3: "task_json", 4: "not_json"}
    assert {r.reason: r.n for r in counts.collect()} == {"task_json": 1, "not_json": 1}


def test_branches(spark):
    df = spark.createDataFrame([("SQL_QUERY",), ("TASK_CREATE",), ("sql_query",), (None,)], "intent string")
    assert {b: d.count() for b, d in ps.by_branch(df).items()} == {"sql": 1, "task": 1, "chat": 2}
