"""Registered queries over record sets and the generated catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.functions import text as tx
from metaquarry.operators import quality as q
from metaquarry.operators.filters import active_columns, active_tables, active_templates
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.catalog_data import (
    UPDATED_AT,
    column_catalog,
    raw_columns,
    raw_tables,
    raw_templates,
    table_catalog,
    template_catalog,
)
from metaquarry.plans.registry import query
from metaquarry.schemas import COLUMNS, TABLES, conformance
from metaquarry.sources.metadata import catalog_counts
from metaquarry.session import new_run_dir
from metaquarry.sources.buckets import BucketTable
from metaquarry.sources.json_arrays import read_array
from metaquarry.sources.records import lookup, publish, read_records, resolve, upsert, write_records

# --------------------------------------------------------------------------- sources and sinks


@query(
    "a3_upsert",
    """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT l_orderkey, 'R', round(sum(l_extendedprice), 2) FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1""",
)
def a3(t):
    current = t.orders.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    incoming = (
        t.lineitem.where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
        .withColumn("o_orderstatus", F.lit("R"))
    )
    return upsert(current, incoming, "o_orderkey")


@query(
    "a3_upsert_versioned",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY event_id DESC, src DESC) AS n FROM (
        SELECT user_id, event_id, event_type, 0 AS src FROM events WHERE event_type <> 'error'
        UNION ALL SELECT user_id, event_id, 'failed', 1 FROM events WHERE event_type IN ('error', 'click')))
      WHERE n = 1""",
)
def a3_versioned(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    incoming = rows.where("event_type in ('error', 'click')").withColumn("event_type", F.lit("failed"))
    return upsert(rows.where("event_type <> 'error'"), incoming, "user_id", "event_id")


@query(
    "a1_read_records",
    """SELECT c_custkey, c_name, c_acctbal FROM customer
      UNION ALL SELECT c_custkey, 'absent', 0 FROM customer WHERE false""",
)
def a1(t):
    """Customers written as JSON lines and read back, with a set that does not exist."""
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    path = new_run_dir(t.spark, "records")
    write_records(rows, path)
    absent = read_records(t.spark, path + "-absent", rows.schema, lines=True)
    return read_records(t.spark, path, rows.schema, lines=True).unionByName(absent)


@query(
    "a1_array_files",
    """SELECT doc_id, text, lang, n_chars FROM documents""",
)
def a1_arrays(t):
    """Documents as JSON arrays with braces and quotes in their texts, read in splits."""
    rows = t.documents.select("doc_id", "text", "lang", "n_chars")
    path = new_run_dir(t.spark, "arrays")
    record = F.struct("doc_id", F.struct(F.concat(F.lit('}"{\\'), "text").alias("text"), F.lit("}").alias("x")).alias("body"), "lang", "n_chars")
    arrays = rows.groupBy(F.pmod("doc_id", F.lit(16))).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.text(path)
    schema = "doc_id long, body struct<text: string, x: string>, lang string, n_chars long"
    back = read_array(t.spark, path, schema)
    return back.select("doc_id", F.substring("body.text", 5, 10**9).alias("text"), "lang", "n_chars")


@query(
    "a2_write_records",
    """SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last
      FROM orders GROUP BY 1""",
)
def a2(t):
    """Orders written as Parquet and counted from there."""
    path = new_run_dir(t.spark, "records")
    write_records(t.orders, path, "parquet")
    rows = t.spark.read.parquet(path).groupBy("o_orderstatus")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")
    )


@query(
    "a4_publish",
    """SELECT o_orderstatus, count(*) AS n, 'created,unchanged,updated' AS outcomes FROM orders
      WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def a4(t):
    """Two versions of the orders under one alias; readers see the one published last."""
    base = new_run_dir(t.spark, "published")
    versions = [f"{base}/all", f"{base}/open"]
    write_records(t.orders, versions[0], "parquet")
    write_records(t.orders.where("o_orderstatus <> 'F'"), versions[1], "parquet")
    order = [versions[0], versions[0], versions[1]]
    outcomes = [publish(t.spark, f"{base}/pointers", "orders_current", v).split(" ")[0] for v in order]
    current = t.spark.read.parquet(resolve(t.spark, f"{base}/pointers", "orders_current"))
    counts = current.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("outcomes", F.lit(",".join(outcomes)))


@query(
    "a3_upsert_repeated",
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY 1""",
)
def a3_repeated(t):
    """A customer's balance becomes the price of the last of several orders."""
    current = t.customer.select("c_custkey", "c_acctbal")
    incoming = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey"
    )
    current = current.withColumn("o_orderkey", F.lit(None).cast("long"))
    return upsert(current, incoming, "c_custkey", order_col="o_orderkey").drop("o_orderkey")


@query(
    "a3_upsert_buckets",
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""",
)
def a3_buckets(t):
    """Two upserts into a table of buckets, each rewriting the buckets of its customers only."""
    table = BucketTable.create(t.customer.select("c_custkey", "c_acctbal"), new_run_dir(t.spark, "buckets"), "c_custkey", buckets=32)
    price = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey"
    )
    for part in ("c_custkey % 100 < 2", "c_custkey % 100 >= 2"):
        table.upsert(price.where(part), order_col="o_orderkey")
    return table.read()


@query(
    "a6_lookup",
    """SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('en', 'de')
      AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def a6(t):
    return lookup(
        t.documents,
        "doc_id",
        ["doc_id", "source", "n_chars"],
        {"lang": ["en", "de"], "source": None},
        ids=t.labels.where("quality = 1"),
    )


@query(
    "a7_generate_tables",
    sp.with_(sp.RAW_TABLES, select="SELECT * FROM raw_tables"),
)
def a7_tables(t):
    return raw_tables(t)


@query(
    "a7_generate_columns",
    sp.with_(sp.RAW_TABLES, sp.RAW_COLUMNS, select="SELECT * FROM raw_columns"),
)
def a7_columns(t):
    return raw_columns(t)


@query(
    "a8_catalog_counts",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        select="""SELECT 'tables' AS part, count(*) AS n FROM raw_tables
          UNION ALL SELECT 'columns', count(*) FROM raw_columns
          UNION ALL SELECT 'total', (SELECT count(*) FROM raw_tables) + (SELECT count(*) FROM raw_columns)""",
    ),
)
def a8(t):
    return catalog_counts(raw_tables(t), raw_columns(t))


# --------------------------------------------------------------------------- quality


DOC_FIELDS = {"text": "search_text", "source": "business_domain"}


def _conformance_sql() -> str:
    kinds = {"doc_id": "doc_id", "search_text": "text", "business_domain": "source"}
    rows = []
    for at, f in enumerate(TABLES.fields):
        own = kinds.get(f.name)
        limit = "NULL" if f.limit is None else f.limit
        text = own is not None and f.name != "doc_id"
        rows.append(
            f"SELECT '{f.name}' AS field, {at + 1}::BIGINT AS position, {own is not None} AS is_there, {text} AS kind_fits, "
            f"{f'count(*) FILTER ({own} IS NULL)' if own else 'NULL'}::BIGINT AS n_null, {limit}::BIGINT AS limit_chars, "
            f"{f'max(length({own}))' if text else 'NULL'}::BIGINT AS longest, "
            f"{f'count(*) FILTER (length({own}) > {limit})' if text else 'NULL'}::BIGINT AS n_over{' FROM documents' if own else ''}"
        )
    return " UNION ALL ".join(rows)


@query("b1_catalog_schema", _conformance_sql())
def b1(t):
    """Each field of the table catalog: do the documents have it, of its type and within its limit?"""
    return conformance(t.documents.withColumnsRenamed(DOC_FIELDS), TABLES)


@query(
    "b2_required_fields",
    f"""SELECT '{TABLES.name}' AS collection, count(*) AS n_rows,
      {sp.quote(",".join(f for f in TABLES.required if f not in ("doc_id", *DOC_FIELDS.values())))} AS missing,
      'lang,n_chars' AS extra, false AS complete FROM documents""",
)
def b2(t):
    """Do the documents make a table catalog?"""
    return q.required_fields_report(t.documents.withColumnsRenamed(DOC_FIELDS), TABLES)


@query(
    "b3_check_vector_dim",
    """SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_null,
      min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
      count(*) FILTER (len(embedding) <> 64) AS n_wrong FROM embeddings""",
)
def b3(t):
    return q.check_vector_dim(t.embeddings, "embedding", 64)


DOC_LIMITS = {"text": 4096, "lang": 2, "source": 4}


@query(
    "b5_check_lengths",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, {n} AS limit_chars, max(length({c})) AS longest, "
        f"count(*) FILTER (length({c}) > {n}) AS n_over FROM documents"
        for c, n in DOC_LIMITS.items()
    ),
)
def b5(t):
    return q.check_lengths(t.documents, DOC_LIMITS)


@query(
    "b5_catalog_lengths",
    sp.with_(
        sp.RAW_TABLES,
        sp.TABLE_CATALOG,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS field, {TABLES.limits[c]} AS limit_chars, max(length({expr})) AS longest, "
            f"count(*) FILTER (length({expr}) > {TABLES.limits[c]}) AS n_over FROM table_catalog"
            for c, expr in {
                "doc_id": "doc_id",
                "full_table_name": "full_table_name",
                "table_desc": "table_comment",
                "search_text": "search_text",
            }.items()
        ),
    ),
)
def b5_catalog(t):
    wanted = ("doc_id", "full_table_name", "table_desc", "search_text")
    return q.check_lengths(table_catalog(t), {c: TABLES.limits[c] for c in wanted})


@query(
    "b6_check_key",
    """SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_null,
      count(*) FILTER (n > 1) AS n_duplicated FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""",
)
def b6(t):
    return q.check_key(t.conversations, ["conv_id"])


@query(
    "b7_readiness",
    """WITH r AS (
      SELECT 'embeddings' AS component, count(*) FILTER (len(embedding) <> 64) AS a, 0 AS b, 'n_wrong' AS an, '' AS bn
        FROM embeddings
      UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id), 0, 'n_duplicated', 'n_null' FROM documents
      UNION ALL SELECT 'conversations', (SELECT count(*) FROM (SELECT conv_id FROM conversations
        GROUP BY 1 HAVING count(*) > 1)), 0, 'n_duplicated', 'n_null'),
    s AS (SELECT component, CASE WHEN a = 0 AND b = 0 THEN 'ok' ELSE 'degraded' END AS status,
      an || '=' || a || CASE WHEN bn <> '' THEN ', ' || bn || '=' || b ELSE '' END AS detail FROM r)
    SELECT component, status, detail,
      (SELECT CASE WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'degraded' END FROM s) AS overall FROM s""",
)
def b7(t):
    bad = ["n_duplicated", "n_null"]
    return q.readiness(
        [
            q.status_report("embeddings", q.check_vector_dim(t.embeddings, "embedding", 64), ["n_wrong"]),
            q.status_report("documents", q.check_key(t.documents, ["doc_id"]), bad),
            q.status_report("conversations", q.check_key(t.conversations, ["conv_id"]), bad),
        ]
    )


# --------------------------------------------------------------------------- enrichment


@query(
    "c1_table_catalog",
    sp.with_(
        sp.RAW_TABLES,
        sp.TABLE_CATALOG,
        select=f"""SELECT doc_id, 'default' AS tenant_id, 'dev' AS env, 'ACTIVE' AS status, 1 AS schema_version,
          data_source AS datasource_id, '' AS catalog_name, schema_of AS database_name, schema_of AS schema_name,
          table_name, full_table_name, CASE WHEN is_fact_table THEN 'FACT' ELSE 'DIM' END AS table_type,
          'ANSI' AS dialect, table_name AS business_name, table_name AS alias, business_domain,
          table_comment AS grain_desc, table_comment AS table_desc, 0 AS n_lists, '' AS row_count_level,
          '' AS freshness_sla, '' AS owner, 'INTERNAL' AS security_level, TRUE AS is_active, search_text,
          {UPDATED_AT} AS updated_at FROM table_catalog""",
    ),
)
def c1(t):
    rows = table_catalog(t)
    lists = ["primary_keys", "partition_keys", "time_columns", "join_hints"]
    return rows.withColumns(
        {"alias": F.element_at("aliases", 1), "n_lists": F.size(F.concat(*lists)).cast("long")}
    ).drop("aliases", "payload", *lists)


@query(
    "c2_column_catalog",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        sp.COLUMN_CATALOG,
        select=f"""SELECT doc_id, table_id, 'default' AS tenant_id, 'dev' AS env, 'ACTIVE' AS status,
          1 AS schema_version, source_of AS datasource_id, schema_of AS database_name, schema_of AS schema_name,
          table_name, column_name, full_column_name, column_comment AS business_name, column_name AS alias,
          data_type, semantic_type, CASE WHEN semantic_type = 'METRIC' THEN 'SUMMABLE' ELSE 'NON_AGG' END AS metric_role,
          is_primary_key, is_foreign_key, is_nullable, FALSE AS is_partition_key,
          semantic_type = 'TIME' AS is_time_column, '' AS time_granularity,
          enum_values::JSON->>'A' AS enum_a, '' AS unit, business_meaning AS column_desc,
          'INTERNAL' AS security_level, TRUE AS is_queryable, TRUE AS is_active, search_text,
          {UPDATED_AT} AS updated_at FROM column_catalog""",
    ),
)
def c2(t):
    rows = column_catalog(t)
    return rows.withColumns(
        {
            "alias": F.element_at("aliases", 1),
            "enum_a": F.get_json_object("enum_values", "$.A"),
        }
    ).drop("aliases", "payload", "enum_values", "sample_values", "aggregation_hints", "join_hints")


TEMPLATE_SLOTS = """CASE WHEN p_size % 2 = 0 THEN '["source_table", "target_table"]'
  ELSE '["source_table", "target_table", "schedule"]' END"""


@query(
    "c3_template_catalog",
    f"""SELECT 'template::' || p_partkey AS doc_id, 'default' AS tenant_id, 'dev' AS env, 'ACTIVE' AS status,
      1 AS schema_version, 't' || p_partkey AS template_code, p_name || ' load ' || p_brand AS template_name,
      p_type AS template_type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS business_domain,
      CASE WHEN p_size % 2 = 0 THEN 'source_table,target_table' ELSE 'source_table,target_table,schedule' END AS required,
      0 AS n_optional, p_type AS mode, CASE WHEN p_size % 2 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS risk_level,
      'v1' AS version_name, p_size % 7 <> 0 AS is_active,
      p_name || ' load ' || p_brand || chr(10) || p_type || chr(10) || 'moves ' || p_name || ' ' || p_type
        || ' rows' || chr(10) || {TEMPLATE_SLOTS} || chr(10) || '["MYSQL"]' || chr(10)
        || CASE WHEN p_size % 3 = 0 THEN '["HIVE"]' ELSE '["DORIS"]' END AS search_text,
      {UPDATED_AT} AS updated_at FROM part""",
)
def c3(t):
    rows = template_catalog(t)
    return rows.select(
        "doc_id",
        "tenant_id",
        "env",
        "status",
        "schema_version",
        "template_code",
        "template_name",
        "template_type",
        "business_domain",
        F.array_join("required_slots", ",").alias("required"),
        F.size("optional_slots").cast("long").alias("n_optional"),
        F.element_at("default_payload", "mode").alias("mode"),
        "risk_level",
        "version_name",
        "is_active",
        "search_text",
        "updated_at",
    )


@query(
    "c4_doc_ids",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        select=f"""SELECT 'table::' || {sp.SCHEMA_OF} || '::' || table_name AS doc_id FROM raw_tables
          UNION ALL SELECT 'column::dw::' || table_name || '::' || column_name FROM raw_columns""",
    ),
)
def c4(t):
    tables = raw_tables(t).select(
        tx.table_doc_id(F.col("schema_name"), F.col("database_name"), F.col("table_name")).alias("doc_id")
    )
    columns = raw_columns(t).select(
        tx.column_doc_id(F.lit("dw"), F.col("table_name"), F.col("column_name")).alias("doc_id")
    )
    return tables.unionByName(columns)


@query(
    "c5_semantic_type",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        select=f"SELECT {sp.SEMANTIC} AS semantic_type, data_type, count(*) AS n FROM raw_columns GROUP BY 1, 2",
    ),
)
def c5(t):
    kind = tx.semantic_type(F.col("column_name"), F.col("data_type"), F.col("is_primary_key"))
    return raw_columns(t).groupBy(kind.alias("semantic_type"), "data_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c6_metric_role",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        select=f"""SELECT CASE WHEN ({sp.SEMANTIC}) = 'METRIC' THEN 'SUMMABLE' ELSE 'NON_AGG' END AS metric_role,
          table_name, count(*) AS n FROM raw_columns GROUP BY 1, 2""",
    ),
)
def c6(t):
    kind = tx.semantic_type(F.col("column_name"), F.col("data_type"), F.col("is_primary_key"))
    return raw_columns(t).groupBy(tx.metric_role(kind).alias("metric_role"), "table_name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c7_search_text",
    r"""SELECT doc_id, regexp_replace(text || chr(10) || coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '')
      || chr(10) || source || chr(10) || '', '^\s+|\s+$', '', 'g') AS search_text FROM documents""",
)
def c7(t):
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    parts = [F.col("text"), lang, F.col("source"), F.lit("")]
    return t.documents.select("doc_id", tx.search_text(*parts).alias("search_text"))


@query(
    "c8_describe",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        select="""SELECT table_name AS name, text FROM raw_tables
          UNION ALL SELECT table_name || '.' || column_name, text FROM raw_columns""",
    ),
)
def c8(t):
    tables = raw_tables(t).select(F.col("table_name").alias("name"), tx.describe_table().alias("text"))
    columns = raw_columns(t).select(
        F.concat_ws(".", "table_name", "column_name").alias("name"), tx.describe_column().alias("text")
    )
    return tables.unionByName(columns)


@query(
    "c9_normalize_json",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'OBJECT<k: BIGINT>' WHEN 'click' THEN 'BIGINT'
        WHEN 'error' THEN 'BOOLEAN' ELSE 'STRING' END AS kind,
      CASE WHEN event_type = 'view' THEN (props::JSON->>'k')::BIGINT END AS k,
      CASE WHEN event_type IN ('purchase', 'signup') THEN props || ' plain "text"' END AS raw
    FROM events""",
)
def c9(t):
    raw = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", "12")
        .when(F.col("event_type") == "error", "true")
        .otherwise(F.concat("props", F.lit(' plain "text"')))
    )
    v = t.events.select("event_id", tx.normalize_json(raw).alias("v"))
    kind = F.schema_of_variant("v")
    return v.select(
        "event_id",
        kind.alias("kind"),
        F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.when(kind == "STRING", F.col("v").cast("string")).alias("raw"),
    )


# --------------------------------------------------------------------------- filters


@query(
    "d3_active_tables",
    sp.with_(
        sp.RAW_TABLES,
        sp.TABLE_CATALOG,
        select="""SELECT doc_id, business_domain FROM table_catalog
          WHERE data_source = 'card_index' AND business_domain = 'archives'""",
    ),
)
def d3(t):
    rows = active_tables(
        table_catalog(t), datasource_id="card_index", business_domain="archives", dialect="ANSI", env="dev"
    )
    return rows.select("doc_id", "business_domain")


@query(
    "d4_active_columns",
    sp.with_(
        sp.RAW_TABLES,
        sp.RAW_COLUMNS,
        sp.TABLE_CATALOG,
        sp.COLUMN_CATALOG,
        select="""SELECT doc_id, table_id FROM column_catalog
          WHERE table_id IN (SELECT doc_id FROM table_catalog WHERE is_fact_table)""",
    ),
)
def d4(t):
    facts = table_catalog(t).where("table_type = 'FACT'").select(F.col("doc_id").alias("table_id"))
    return active_columns(column_catalog(t), facts, env="dev").select("doc_id", "table_id")


@query(
    "d5_active_templates",
    """SELECT 'template::' || p_partkey AS doc_id FROM part
      WHERE p_size % 7 <> 0 AND p_type = 'ECONOMY'""",
)
def d5(t):
    return active_templates(template_catalog(t), template_type="ECONOMY").select("doc_id")
