import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from metaquarry import schemas as sc
from metaquarry.operators import quality as q
from metaquarry.operators.catalogs import build_table_catalog, build_template_catalog, with_vectors
from metaquarry.sources import records as rc
from metaquarry.sources.metadata import catalog_counts, generate_columns, generate_tables, table_numbers


def test_catalog_definitions():
    assert sc.catalog("metaquarry_tables") is sc.TABLES
    assert len(sc.TABLES.required) == 31 and len(sc.COLUMNS.required) == 36 and len(sc.TEMPLATES.required) == 29
    assert len(sc.TABLES.output) == 19 and len(sc.COLUMNS.output) == 24 and len(sc.TEMPLATES.output) == 21
    assert sc.TABLES.limits["doc_id"] == 64 and sc.COLUMNS.limits["full_column_name"] == 768
    with pytest.raises(KeyError):
        sc.catalog_schema("nothing")


def test_catalogs_have_all_required_fields(spark):
    raw = generate_tables(table_numbers(spark, 12))
    catalog = with_vectors(build_table_catalog(raw, 1), 16)
    q.check_required_fields(catalog, sc.TABLES)
    assert q.extra_fields(catalog, sc.TABLES) == []
    assert q.missing_required_fields(catalog.drop("owner"), sc.TABLES) == ["owner"]
    with pytest.raises(ValueError):
        q.check_required_fields(catalog.drop("owner"), sc.TABLES)
    counts = {r.part: r.n for r in catalog_counts(raw, generate_columns(raw)).collect()}
    assert counts["tables"] == 12 and counts["total"] == 12 + counts["columns"]
    assert 8 * 12 <= counts["columns"] <= 20 * 12


def test_read_and_write_records(spark):
    base = tempfile.mkdtemp()
    assert rc.read_records(spark, base + "/none.json", sc.catalog_schema("table")).count() == 0
    with open(base + "/t.json", "w", encoding="utf-8") as f:
        json.dump([{"doc_id": "x", "template_code": "c", "required_slots": ["a"],
                    "slot_schema": {"a": {"type": "string"}}, "default_payload": {"n": 5}}], f)
    rows = rc.read_records(spark, base + "/t.json", sc.catalog_schema("template"))
    row = rows.first()
    assert row.required_slots == ["a"] and row.slot_schema["a"]["type"] == "string"
    assert row.default_payload == {"n": "5"}
    made = build_template_catalog(rows, 1).first()
    assert made.risk_level == "MEDIUM" and made.version_name == "v1" and made.is_active is True
    assert made.optional_slots == [] and made.env == "dev"
    rc.write_records(rows, base + "/out")
    assert rc.read_records(spark, base + "/out", rows.schema, lines=True).count() == 1


def test_upsert(spark):
    cur = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 2, 5), ("c", 2, 4)], "k string, v int, at int")
    assert sorted(map(tuple, rc.upsert(cur, new, "k").collect())) == [("a", 1, 5), ("b", 2, 5), ("c", 2, 4)]
    stale = spark.createDataFrame([("a", 9, 4), ("b", 9, 5)], "k string, v int, at int")
    assert sorted(map(tuple, rc.upsert(cur, stale, "k", "at").collect())) == [("a", 1, 5), ("b", 9, 5)]
    assert rc.upsert(cur, cur.limit(0), "k").count() == 2


def test_publish(spark):
    base = tempfile.mkdtemp()
    for v in (1, 2):
        spark.range(v).write.parquet(f"{base}/v{v}")
    log = base + "/aliases"
    assert rc.resolve(spark, log, "things") == "things"
    assert rc.publish(spark, log, "things", base + "/v1") == "created"
    assert rc.publish(spark, log, "things", base + "/v1") == "unchanged"
    assert rc.publish(spark, log, "things", base + "/v2") == f"updated ({base}/v1 -> {base}/v2)"
    assert rc.resolve(spark, log, "things").endswith("/v2")
    assert spark.table("things").count() == 2


def test_quality_reports(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [1.0]), (None, None)], "k string, v array<double>"
    )
    dim = q.check_vector_dim(df, "v", 2).first()
    assert (dim.n_rows, dim.n_null, dim.min_dim, dim.max_dim, dim.n_wrong) == (3, 1, 1, 2, 1)
    key = q.check_key(df, ["k"]).first()
    assert (key.n_rows, key.n_keys, key.n_null, key.n_duplicated) == (3, 1, 1, 1)
    long = q.check_lengths(df, {"k": 0, "absent": 3}).collect()
    assert [(r.field, r.longest, r.n_over) for r in long] == [("k", 1, 2)]
    good = q.status_report("good", q.check_vector_dim(df.where("size(v) = 2"), "v", 2), ["n_wrong"])
    bad = q.status_report("bad", q.check_key(df, ["k"]), ["n_null", "n_duplicated"])
    rows = {r.component: r for r in q.readiness([good, bad]).collect()}
    assert rows["good"].status == "ok" and rows["bad"].status == "degraded"
    assert {r.overall for r in rows.values()} == {"degraded"}
    assert rows["bad"].detail == "n_null=1, n_duplicated=1"


def test_shared_dir_is_read_from_the_session(spark):
    from metaquarry.session import new_run_dir, shared_dir

    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert new_run_dir(spark, "x").startswith(folder.rstrip("/"))
    assert not os.path.exists(new_run_dir(spark, "x"))
