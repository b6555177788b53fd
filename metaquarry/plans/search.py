"""Registered searches over documents, embeddings and the generated catalogs."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from metaquarry.functions.text import tokens
from metaquarry.models import group_hash_embedding, hash_embedding, md5_bucket
from metaquarry.operators import context as cx
from metaquarry.operators.bm25 import (
    LENGTH_TERM,
    Bm25Index,
    bm25_index,
    bm25_search,
    group_index,
    query_terms,
    tokenize,
)
from metaquarry.operators.cells import CellIndex, knn_cells
from metaquarry.operators.filters import column_filter, table_filter, template_filter
from metaquarry.operators.hybrid import (
    Space,
    hybrid_search,
    normalize_hit,
    normalize_scores,
    search,
    summarize_hits,
    with_fields,
    without_text,
)
from metaquarry.operators.knn import knn_approx, knn_exact, recall
from metaquarry.operators.topk import fits, top_k
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.catalog_data import column_catalog, table_catalog, template_catalog
from metaquarry.plans.registry import query
from metaquarry.schemas import QUERY_INSTRUCTION, TABLES
from metaquarry.session import new_run_dir, spread

DIM = 64
embed = partial(hash_embedding, dim=DIM, bucket=md5_bucket)

# --------------------------------------------------------------------------- inputs


def text_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def vector_queries(t):
    """Benchmark item i with vector i."""
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    vecs = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return items.join(vecs, "query_id")


def hashed_queries(t):
    return text_queries(t).withColumn("query_vector", embed(F.col("query_text")))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense_vector"))


def document_space(t):
    """Document i with vector i; documents without a vector are found by their text."""
    docs = t.documents.select("doc_id", F.col("text").alias("search_text"), "lang", "source")
    own = t.documents.select("doc_id", "lang", "source")
    return Space(docs, vectors=own.join(vectors(t), "doc_id"))


CELLS, CELL_PROBES = 64, 40


def cell_space(t):
    """The same with its vectors saved by cell."""
    space = document_space(t)
    path = new_run_dir(t.spark, "cells")
    CellIndex.save(space.vectors, path, cells=CELLS)
    return replace(space, cells=CellIndex.load(space.vectors, path))


def child_space(t):
    docs = spread(t.documents).select("doc_id", F.col("text").alias("search_text"), "lang", "source")
    return Space(
        docs.withColumn("dense_vector", embed(F.col("search_text"))), parent_col="source"
    )


def parent_space(t, queries):
    """Each source, indexed as the texts of all its documents together."""
    docs = t.documents.select("source", "text")
    vocabulary = query_terms(queries, "query_id", "query_text").select("term").distinct()
    index = group_index(docs, "source", "text", vocabulary, fits(vocabulary))
    rows = group_hash_embedding(docs, "source", "text", DIM, md5_bucket)
    # documents without a source are a group without a name, which has no direction (as in the SQL)
    none = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    vector = F.when(F.col("source").isNull(), none).otherwise(F.col("dense_vector"))
    return Space(rows.withColumn("dense_vector", vector), id_col="source", index=index)


def questions(t):
    """One question per kind of part, worded with its name and type."""
    kinds = t.part.select("p_name", "p_type").distinct()
    text = F.concat(F.lit("facts about "), "p_name", F.lit(" "), "p_type")
    return cx.ask(
        kinds.select(F.concat_ws("/", "p_name", "p_type").alias("query_id"), text.alias("query_text")), embed
    )


Q_TEXT = "SELECT item_id AS query_id, text AS txt FROM benchmark"
Q_VEC = """SELECT item_id AS query_id, embedding::DOUBLE[] AS qv FROM benchmark
  JOIN embeddings ON item_id = vec_id"""
Q_BOTH = "SELECT item_id AS query_id, text AS txt FROM benchmark JOIN embeddings ON item_id = vec_id"
V_ALL = "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings"
D_ALL = "SELECT doc_id, text AS txt FROM documents"
D_BOTH = "SELECT doc_id, text AS txt, lang, source FROM documents"

# --------------------------------------------------------------------------- text


@query(
    "e01_tokenize",
    f"""SELECT doc_id, term, count(*) AS tf FROM
    (SELECT doc_id, unnest({sp.tokens("text")}) AS term FROM documents) GROUP BY 1, 2""",
)
def e01(t):
    rows = tokenize(spread(t.documents), "doc_id", "text")
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(
    "e02_bm25_index",
    sp.with_(
        sp.counted("", D_ALL),
        select="""SELECT term, df, sum_tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf,
          n AS n_docs, round(a, 6) AS avg_len
        FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS sum_tf FROM tf GROUP BY 1), stat""",
    ),
)
def e02(t):
    ix = bm25_index(t.documents, "doc_id", "text")
    s = ix.stats.select(F.struct("n_docs", "avg_len")).scalar()
    per_term = ix.postings.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(
        F.count("tf").alias("df"), F.sum("tf").alias("sum_tf")
    )
    return per_term.select(
        "term",
        "df",
        "sum_tf",
        F.round(F.log(1 + (s["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"),
        s["n_docs"].alias("n_docs"),
        F.round(s["avg_len"], 6).alias("avg_len"),
    )


@query(
    "e03_bm25_search",
    sp.with_(
        sp.counted("", D_ALL),
        sp.bm25("", Q_TEXT),
        sp.ranked("hits", "sparse", "sparse", 5),
        select="SELECT query_id, doc_id, sparse, rk FROM hits",
    ),
)
def e03(t):
    return bm25_search(text_queries(t), t.documents, 5)


@query(
    "e03_bm25_saved",
    sp.with_(
        sp.counted("", D_ALL),
        sp.bm25("", Q_TEXT),
        sp.ranked("hits", "sparse", "sparse", 5),
        select="SELECT query_id, doc_id, sparse, rk FROM hits",
    ),
)
def e03_saved(t):
    """The same search in an index saved before: only the folders of its terms are read."""
    path = new_run_dir(t.spark, "index")
    bm25_index(t.documents, "doc_id", "text").save(path)
    return bm25_search(text_queries(t), Bm25Index.load(t.spark, path, "doc_id"), 5)


@query(
    "d1_build_filter",
    sp.with_(
        sp.counted("", "SELECT doc_id, text AS txt, lang, source FROM documents", "lang, source"),
        sp.bm25("", Q_TEXT, "lang = 'en' AND source IN ('src1', 'src2', 'src3')"),
        sp.ranked("hits", "sparse", "sparse", 3),
        select="SELECT query_id, doc_id, sparse, rk FROM hits",
    ),
)
def d1(t):
    from metaquarry.operators.filters import build_filter

    wanted = {"lang": "en", "source": ["src1", None, "src2", "src3"], "n_chars": None, "doc_id": []}
    return bm25_search(
        text_queries(t), t.documents, 3, carried=("lang", "source"), where=build_filter(wanted)
    )


# --------------------------------------------------------------------------- vectors

KNN_SQL = sp.with_(
    sp.dense("", Q_VEC, V_ALL, "query_id <> doc_id"),
    sp.ranked("hits", "cos", "cosine", 5),
    select="SELECT query_id, doc_id, cosine, rk FROM hits",
)


@query("e04_knn_exact", KNN_SQL)
def e04(t):
    return knn_exact(vector_queries(t), vectors(t), 5, exclude_same=True)


LSH = {"tables": 16, "bits": 6, "probes": 2}
# every vector's bucket in every table, and the buckets each query looks in
BUCKETS = f"""
planes AS (SELECT p, list((('0x' || substr(md5(p || ':' || d), 1, 4))::BIGINT - 32768)::DOUBLE ORDER BY d) AS a
  FROM (SELECT unnest(range({LSH["tables"] * LSH["bits"]})) AS p), (SELECT unnest(range({DIM})) AS d) GROUP BY p),
grid AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 1048576 + 0.5)) AS g FROM embeddings),
sides AS (SELECT vec_id, p // {LSH["bits"]} AS tab, p % {LSH["bits"]} AS bit, list_dot_product(g, a) AS side,
    abs(list_dot_product(g, a)) / sqrt(list_dot_product(a, a)) AS far FROM grid, planes),
own AS (SELECT vec_id, tab, sum(CASE WHEN side > 0 THEN 1 << bit ELSE 0 END)::BIGINT AS bucket FROM sides GROUP BY 1, 2),
probe AS (SELECT * FROM own UNION ALL
  SELECT vec_id, tab, xor(bucket, (1 << bit)::BIGINT) FROM
    (SELECT *, row_number() OVER (PARTITION BY vec_id, tab ORDER BY far, bit) AS n FROM sides)
    JOIN own USING (vec_id, tab) WHERE n <= {LSH["probes"]}),
met AS (SELECT DISTINCT p.vec_id AS query_id, o.vec_id AS doc_id FROM probe p JOIN own o USING (tab, bucket)
  WHERE p.vec_id IN (SELECT item_id FROM benchmark))"""


@query(
    "e05_knn_approx",
    sp.with_(
        BUCKETS,
        sp.dense("", Q_VEC, V_ALL, "query_id <> doc_id AND (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM met)"),
        sp.ranked("hits", "cos", "cosine", 5),
        select="SELECT query_id, doc_id, cosine, rk FROM hits",
    ),
)
def e05(t):
    return knn_approx(vector_queries(t), vectors(t), 5, dim=DIM, exclude_same=True, **LSH)


@query(
    "e05_knn_recall",
    sp.with_(
        BUCKETS,
        sp.dense("", Q_VEC, V_ALL, "query_id <> doc_id"),
        sp.ranked("hits", "cos", "cosine", 5),
        select="""SELECT query_id, round(count(*) FILTER ((query_id, doc_id) IN (SELECT (query_id, doc_id) FROM met))
          / count(*), 4) AS recall FROM hits GROUP BY 1""",
    ),
)
def e05_recall(t):
    qs, vs = vector_queries(t), vectors(t)
    truth = knn_exact(qs, vs, 5, exclude_same=True)
    found = knn_approx(qs, vs, 5, dim=DIM, exclude_same=True, **LSH)
    return recall(found, truth, "query_id", "doc_id")


@query(
    "e06_top_k",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rk FROM lineitem) WHERE rk <= 5""",
)
def e06(t):
    lines = t.lineitem.withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    best = top_k(lines, "l_suppkey", "l_extendedprice", 5, "line_id")
    return best.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rk")


@query(
    "c12_hash_embedding",
    sp.with_(
        sp.hashed("", "SELECT doc_id, text AS txt FROM documents", DIM),
        select="""SELECT doc_id, b AS pos, round((c / norm)::FLOAT::DOUBLE, 6) AS weight
          FROM hb JOIN hn USING (doc_id)""",
    ),
)
def c12(t):
    vecs = spread(t.documents).select("doc_id", embed(F.col("text")).alias("v"))
    cells = vecs.select("doc_id", F.posexplode_outer("v").alias("pos", "w"))
    return cells.where("w <> 0").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


# --------------------------------------------------------------------------- hybrid

HYBRID = (
    sp.counted("", D_BOTH, "lang, source"),
    sp.bm25("", Q_BOTH),
    sp.dense("", Q_VEC, "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id"),
    sp.fused("", 5),
)


@query(
    "e07_hybrid_search",
    sp.with_(*HYBRID, select="SELECT query_id, doc_id, cosine, sparse, score, rk FROM hits"),
)
def e07(t):
    return hybrid_search(vector_queries(t), document_space(t), 5)


CENTRES = f"""
cgrid AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 1048576 + 0.5)) AS g
  FROM embeddings JOIN documents ON doc_id = vec_id),
csample AS (SELECT g, n FROM (SELECT g, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM cgrid)
  WHERE n < 20000),
centre0 AS (SELECT n AS cell, g AS c FROM csample WHERE n < {CELLS})"""
NEAR = "list_dot_product(g, c) / coalesce(nullif(sqrt(list_dot_product(c, c)), 0), 'inf'::DOUBLE)"


def _moved(i: int) -> str:
    """Centres after one more round."""
    return f"""
own{i} AS (SELECT n, g, cell FROM csample, centre{i - 1}
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY {NEAR} DESC, cell) = 1),
centre{i} AS (
  SELECT cell, list(floor(total / m) ORDER BY i) AS c FROM (
    SELECT cell, i, sum(x) AS total, count(*) AS m FROM
      (SELECT cell, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM own{i}) GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT cell, c FROM centre{i - 1} WHERE cell NOT IN (SELECT cell FROM own{i}))"""


CELL_HITS = f"""
cells AS (SELECT doc_id, cell FROM cgrid, centre2
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {NEAR} DESC, cell) = 1),
asked AS (SELECT item_id AS query_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 1048576 + 0.5)) AS g
  FROM benchmark JOIN embeddings ON item_id = vec_id),
looked AS (SELECT query_id, cell FROM asked, centre2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {NEAR} DESC, cell) <= {CELL_PROBES}),
met AS (SELECT query_id, doc_id FROM looked JOIN cells USING (cell))"""
D_VEC = "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id"


@query(
    "e07_hybrid_approx",
    sp.with_(
        CENTRES,
        _moved(1),
        _moved(2),
        CELL_HITS,
        sp.counted("", D_BOTH, "lang, source"),
        sp.bm25("", Q_BOTH),
        sp.dense("", Q_VEC, D_VEC, "(query_id, doc_id) IN (SELECT (query_id, doc_id) FROM met)"),
        sp.fused("", 5),
        select="SELECT query_id, doc_id, cosine, sparse, score, rk FROM hits",
    ),
)
def e07_approx(t):
    """Hybrid search whose vector branch reads the nearest cells only."""
    return hybrid_search(vector_queries(t), cell_space(t), 5, exact_dense=False, probes=CELL_PROBES)


@query(
    "e07_cell_recall",
    sp.with_(
        CENTRES,
        _moved(1),
        _moved(2),
        CELL_HITS,
        sp.dense("", Q_VEC, D_VEC),
        sp.ranked("hits", "cos", "cosine", 25),
        select="""SELECT query_id, round(count(*) FILTER ((query_id, doc_id) IN (SELECT (query_id, doc_id) FROM met))
          / count(*), 4) AS recall FROM hits GROUP BY 1""",
    ),
)
def e07_recall(t):
    """Share of the 25 nearest documents, the candidates of a hybrid search, that the cells give."""
    qs, space = vector_queries(t), cell_space(t)
    truth = knn_exact(qs, space.vectors, 25)
    found = knn_cells(qs, space.cells, 25, probes=CELL_PROBES)
    return recall(found, truth, "query_id", "doc_id")


@query(
    "e07_hybrid_filtered",
    sp.with_(
        sp.counted("", D_BOTH, "lang, source"),
        sp.bm25("", Q_BOTH, "lang IN ('en', 'fr')"),
        sp.dense(
            "",
            Q_VEC,
            "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings "
            "JOIN documents ON doc_id = vec_id WHERE lang IN ('en', 'fr')",
        ),
        sp.fused("", 3),
        select="SELECT query_id, doc_id, cosine, sparse, score, rk FROM hits",
    ),
)
def e07_filtered(t):
    return hybrid_search(vector_queries(t), document_space(t), 3, filters={"lang": ["en", "fr"]})


@query(
    "e08_normalize_scores",
    sp.with_(
        *HYBRID,
        select="""SELECT query_id, doc_id, rk, round(coalesce((1 + cosine) / 2, 0), 6) AS dense_norm,
          round(coalesce(2 / pi() * atan(sparse), 0), 6) AS sparse_norm FROM hits""",
    ),
)
def e08(t):
    hits = normalize_scores(hybrid_search(vector_queries(t), document_space(t), 5))
    return hits.select(
        "query_id",
        "doc_id",
        "rk",
        F.round("dense_norm", 6).alias("dense_norm"),
        F.round("sparse_norm", 6).alias("sparse_norm"),
    )


@query(
    "e09_dense_fallback",
    sp.with_(
        sp.dense("", Q_VEC, "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id"),
        sp.ranked("hits", "cos", "cosine", 5),
        select="SELECT query_id, doc_id, cosine AS score, rk FROM hits",
    ),
)
def e09(t):
    hits = hybrid_search(vector_queries(t), without_text(document_space(t)), 5)
    return hits.select("query_id", "doc_id", "score", "rk")


@query(
    "c10_normalize_hit",
    sp.with_(
        *HYBRID,
        select="SELECT query_id, doc_id, source, score FROM hits JOIN documents USING (doc_id)",
    ),
)
def c10(t):
    space = document_space(t)
    hits = with_fields(hybrid_search(vector_queries(t), space, 5), space, ["lang", "source"])
    return normalize_hit(hits, ["doc_id", "source", "no_such_field"])


@query(
    "c11_summarize_hits",
    sp.with_(
        *HYBRID,
        select="""SELECT query_id, rk, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"'
          || coalesce(',"sparse":' || sparse, '') || ',"score":' || round(score::DECIMAL(18, 8), 6)::DOUBLE || '}' AS summary
        FROM hits JOIN documents USING (doc_id)""",
    ),
)
def c11(t):
    space = document_space(t)
    hits = with_fields(hybrid_search(vector_queries(t), space, 5), space, ["lang"])
    return hits.select(
        "query_id", "rk", summarize_hits(hits, ["doc_id", "lang", "sparse"]).alias("summary")
    )


# --------------------------------------------------------------------------- catalogs

Q_KINDS = """SELECT DISTINCT p_name || '/' || p_type AS query_id,
  'facts about ' || p_name || ' ' || p_type AS txt FROM part"""


TEMPLATE_DOCS = """SELECT 'template::' || p_partkey AS doc_id,
  p_name || ' load ' || p_brand || chr(10) || p_type || chr(10) || 'moves ' || p_name || ' ' || p_type
  || ' rows' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '["source_table", "target_table"]'
     ELSE '["source_table", "target_table", "schedule"]' END
  || chr(10) || '["MYSQL"]' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '["HIVE"]' ELSE '["DORIS"]' END AS txt,
  p_size % 7 <> 0 AS live FROM part"""
#: The texts that questions are encoded as.
Q_ENCODED = f"SELECT query_id, '{QUERY_INSTRUCTION}' || txt AS txt FROM ({Q_KINDS})"


def _catalog_sql(docs: str, ctes: tuple[str, ...], where: str, carried: str, k: int, only: str) -> str:
    return sp.with_(
        *ctes,
        sp.counted("", docs, carried),
        sp.bm25("", Q_KINDS, where),
        sp.hashed("q", Q_ENCODED, DIM, "query_id"),
        sp.hashed("d", f"SELECT doc_id, txt FROM docs WHERE {where}", DIM),
        sp.dense("", "SELECT query_id, v AS qv FROM qemb", "SELECT doc_id, v FROM demb"),
        sp.fused("", k),
        select=only,
    )


@query(
    "e10_search_tables",
    _catalog_sql(
        "SELECT doc_id, search_text AS txt, business_domain FROM table_catalog",
        (sp.RAW_TABLES, sp.TABLE_CATALOG),
        "business_domain = 'rivers'",
        "business_domain",
        5,
        """SELECT query_id, doc_id, full_table_name, score, rk FROM hits JOIN table_catalog USING (doc_id)""",
    ),
)
def e10(t):
    space = Space(table_catalog(t, embed))
    hits = cx.search_tables(questions(t), space, env="dev", business_domain="rivers")
    hits = with_fields(hits, space, ["full_table_name"])
    return hits.select("query_id", "doc_id", "full_table_name", "score", "rk")


@query(
    "e11_search_columns",
    _catalog_sql(
        "SELECT doc_id, search_text AS txt FROM column_catalog",
        (sp.RAW_TABLES, sp.RAW_COLUMNS, sp.COLUMN_CATALOG),
        "TRUE",
        "",
        10,
        "SELECT query_id, doc_id, table_id, score, rk FROM hits JOIN column_catalog USING (doc_id)",
    ),
)
def e11(t):
    space = Space(column_catalog(t, embed))
    hits = with_fields(cx.search_columns(questions(t), space), space, ["table_id"])
    return hits.select("query_id", "doc_id", "table_id", "score", "rk")


@query(
    "e12_search_templates",
    _catalog_sql(
        TEMPLATE_DOCS,
        (),
        "live",
        "live",
        3,
        "SELECT query_id, doc_id, score, rk FROM hits",
    ),
)
def e12(t):
    hits = cx.search_templates(questions(t), Space(template_catalog(t, embed)))
    return hits.select("query_id", "doc_id", "score", "rk")


@query(
    "d6_search",
    _catalog_sql(
        "SELECT doc_id, search_text AS txt, business_domain FROM table_catalog",
        (sp.RAW_TABLES, sp.TABLE_CATALOG),
        "business_domain IN ('museums', 'ferries')",
        "business_domain",
        2,
        """SELECT query_id, doc_id, table_name, table_comment AS table_desc, rk
        FROM hits JOIN table_catalog USING (doc_id)""",
    ),
)
def d6(t):
    hits = search(
        questions(t),
        Space(table_catalog(t, embed)),
        2,
        {"status": "ACTIVE", "business_domain": ["museums", "ferries"], "tenant_id": None},
        fields=["table_name", "table_desc"],
    )
    return hits.select("query_id", "doc_id", "table_name", "table_desc", "rk")


@query(
    "d6_search_default",
    _catalog_sql(
        "SELECT doc_id, search_text AS txt, business_domain FROM table_catalog",
        (sp.RAW_TABLES, sp.TABLE_CATALOG),
        "business_domain IN ('museums', 'ferries')",
        "business_domain",
        2,
        """SELECT query_id, rk, doc_id, '"' || data_source || '"' AS datasource_id,
            '"' || schema_of || '"' AS database_name, '"' || schema_of || '"' AS schema_name,
            '"' || table_name || '"' AS table_name, '"' || full_table_name || '"' AS full_table_name,
            CASE WHEN is_fact_table THEN '"FACT"' ELSE '"DIM"' END AS table_type, '"ANSI"' AS dialect,
            '"' || table_name || '"' AS business_name, '["' || table_name || '"]' AS aliases,
            '"' || business_domain || '"' AS business_domain, '"' || table_comment || '"' AS grain_desc,
            '"' || table_comment || '"' AS table_desc, '[]' AS primary_keys, '[]' AS partition_keys,
            '[]' AS time_columns, '[]' AS join_hints, '"INTERNAL"' AS security_level, table_no AS payload_no
          FROM hits JOIN table_catalog USING (doc_id)""",
    ),
)
def d6_default(t):
    """The fields a table search returns of itself, texts that are JSON as values."""
    wanted = {"status": "ACTIVE", "business_domain": ["museums", "ferries"]}
    hits = search(questions(t), Space.of(table_catalog(t, embed), TABLES), 2, wanted, json=True)
    plain = {f: F.to_json(F.col(f)) for f in TABLES.output if f not in ("doc_id", "payload")}
    number = F.variant_get("payload", "$.table_no", "long").alias("payload_no")
    return hits.select("query_id", "rk", "doc_id", *[c.alias(f) for f, c in plain.items()], number)


# --------------------------------------------------------------------------- two stages

TWO_STAGE = (
    # parents: every source with the tokens of all its documents
    "ptf AS (SELECT source AS doc_id, term, count(*) AS tf FROM (SELECT source, unnest("
    + sp.tokens("text")
    + ") AS term FROM documents) GROUP BY 1, 2),",
    "plen AS (SELECT source AS doc_id, sum(len(" + sp.tokens("text") + ")) AS doc_len FROM documents GROUP BY 1),",
    "pdf AS (SELECT term, count(*) AS df FROM ptf GROUP BY 1),",
    "pstat AS (SELECT count(*) AS n, avg(doc_len) AS a FROM plen),",
    sp.bm25("p", Q_TEXT),
    sp.hashed("q", Q_TEXT, DIM, "query_id"),
    sp.hashed("e", "SELECT source AS doc_id, text AS txt FROM documents", DIM),
    sp.dense("p", "SELECT query_id, v AS qv FROM qemb", "SELECT doc_id, v FROM eemb"),
    sp.fused("p", 4),
    # children: documents of the query's own parents
    sp.counted("c", "SELECT doc_id, text AS txt, source FROM documents", "source"),
    sp.bm25("c", Q_TEXT, "(query_id, source) IN (SELECT (query_id, doc_id) FROM phits)"),
    sp.hashed("h", D_ALL, DIM),
    sp.dense(
        "c",
        "SELECT query_id, v AS qv FROM qemb",
        "SELECT doc_id, source, v FROM hemb JOIN documents USING (doc_id)",
        "(query_id, source) IN (SELECT (query_id, doc_id) FROM phits)",
    ),
)


@query(
    "e13_search_sql_context",
    sp.with_(
        *TWO_STAGE,
        sp.fused("c", 12),
        select="""SELECT query_id, 'table' AS kind, doc_id AS hit, score, rk FROM phits UNION ALL
          SELECT query_id, 'column', doc_id::VARCHAR, score, rk FROM chits""",
    ),
)
def e13(t):
    qs = hashed_queries(t)
    first, second = cx.search_sql_context(qs, parent_space(t, qs), child_space(t))
    rows = ["query_id", "kind", "hit", "score", "rk"]
    return (
        first.withColumns({"kind": F.lit("table"), "hit": F.col("source")})
        .select(rows)
        .unionByName(
            second.withColumns({"kind": F.lit("column"), "hit": F.col("doc_id").cast("string")}).select(rows)
        )
    )


@query(
    "e14_search_schemas",
    sp.with_(
        *TWO_STAGE,
        sp.fused("c", 10),
        select="""SELECT p.query_id, p.doc_id AS source, p.rk, c.rk AS child_rk, c.doc_id AS child_id
          FROM phits p LEFT JOIN (SELECT chits.*, source FROM chits JOIN documents USING (doc_id)) c
          ON p.query_id = c.query_id AND p.doc_id = c.source""",
    ),
)
def e14(t):
    qs = hashed_queries(t)
    schemas = cx.search_schemas(qs, parent_space(t, qs), child_space(t), 5)
    flat = schemas.select("query_id", "source", "rk", F.explode_outer("children").alias("c"))
    return flat.select("query_id", "source", "rk", F.col("c.rk").alias("child_rk"), "c.child_id")


@query(
    "e15_coverage",
    sp.with_(
        *TWO_STAGE,
        sp.fused("c", 12),
        sp.counted("g", "SELECT doc_id, text AS txt, lang FROM documents", "lang"),
        sp.bm25("g", Q_TEXT, "lang = 'de'"),
        select="""SELECT item_id AS query_id,
          item_id IN (SELECT query_id FROM phits) AS has_tables,
          item_id IN (SELECT query_id FROM chits) AS has_columns,
          item_id IN (SELECT query_id FROM gsparse) AS has_templates,
          item_id IN (SELECT query_id FROM phits) AND item_id IN (SELECT query_id FROM chits)
            AND item_id IN (SELECT query_id FROM gsparse) AS covered FROM benchmark""",
    ),
)
def e15(t):
    qs = hashed_queries(t)
    first, second = cx.search_sql_context(qs, parent_space(t, qs), child_space(t))
    third = bm25_search(qs, t.documents, 3, carried=("lang",), where=F.col("lang") == "de")
    return cx.coverage(qs, tables=first, columns=second, templates=third)


@query(
    "f1_columns_per_table",
    sp.with_(
        *TWO_STAGE,
        sp.fused("c", 12),
        select="""SELECT query_id, source, doc_id, slot FROM (
          SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY rk) AS slot
          FROM chits JOIN documents USING (doc_id)) WHERE slot <= 2""",
    ),
)
def f1(t):
    qs = hashed_queries(t)
    first, second = cx.search_sql_context(qs, parent_space(t, qs), child_space(t))
    kept = cx.columns_per_table(first, second, "source", "source", 2)
    return kept.select("query_id", "source", "doc_id", "slot")


CATALOG_STAGES = (
    sp.RAW_TABLES,
    sp.RAW_COLUMNS,
    sp.TABLE_CATALOG,
    sp.COLUMN_CATALOG,
    sp.hashed("q", Q_ENCODED, DIM, "query_id"),
    sp.counted("p", "SELECT doc_id, search_text AS txt FROM table_catalog"),
    sp.bm25("p", Q_KINDS),
    sp.hashed("e", "SELECT doc_id, search_text AS txt FROM table_catalog", DIM),
    sp.dense("p", "SELECT query_id, v AS qv FROM qemb", "SELECT doc_id, v FROM eemb"),
    sp.fused("p", 4),
    sp.counted("c", "SELECT doc_id, search_text AS txt, table_id FROM column_catalog", "table_id"),
    # only columns of the query's own tables, joined from the table hits
    "cqt AS (SELECT DISTINCT query_id, unnest(" + sp.tokens("txt") + f") AS term FROM ({Q_KINDS}))",
    """own AS (SELECT p.query_id, l.doc_id, l.doc_len FROM phits p JOIN clen l ON l.table_id = p.doc_id)""",
    """csparse AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))), 4) AS sparse
      FROM own JOIN cqt USING (query_id) JOIN ctf USING (doc_id, term) JOIN cdf USING (term), cstat GROUP BY 1, 2)""",
    sp.hashed("h", "SELECT doc_id, search_text AS txt FROM column_catalog", DIM),
    """ccos AS (SELECT o.query_id, o.doc_id, round(coalesce(list_dot_product(q.v, h.v)
        / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(h.v, h.v)), 0), 0), 6) AS cosine
      FROM own o JOIN hemb h ON h.doc_id = o.doc_id JOIN qemb q ON q.query_id = o.query_id)""",
    sp.fused("c", 12),
)


@query(
    "f2_render_schema_context",
    sp.with_(
        *[c for c in CATALOG_STAGES[:-1]],
        CATALOG_STAGES[-1],
        """lines AS (SELECT query_id, table_id, string_agg('  - ' || full_column_name || ' | type=' || data_type
            || ' | semantic=' || semantic_type || ' | metric='
            || CASE WHEN semantic_type = 'METRIC' THEN 'SUMMABLE' ELSE 'NON_AGG' END
            || ' | desc=' || business_meaning, chr(10) ORDER BY slot) AS cols
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id, table_id ORDER BY rk) AS slot
            FROM chits JOIN column_catalog USING (doc_id)) WHERE slot <= 8 GROUP BY 1, 2)""",
        select="""SELECT query_id, string_agg('Table: ' || full_table_name || chr(10) || 'Type: '
            || CASE WHEN is_fact_table THEN 'FACT' ELSE 'DIM' END || chr(10) || 'Dialect: ANSI' || chr(10)
            || 'Business Name: ' || table_name || chr(10) || 'Business Domain: ' || business_domain || chr(10)
            || 'Description: ' || table_comment || chr(10) || 'Grain: ' || table_comment || chr(10)
            || 'Primary Keys: []' || chr(10) || 'Partition Keys: []' || chr(10) || 'Time Columns: []' || chr(10)
            || 'Join Hints: []' || coalesce(chr(10) || 'Columns:' || chr(10) || cols, ''),
            chr(10) || chr(10) ORDER BY rk) AS context
          FROM phits JOIN table_catalog USING (doc_id)
          LEFT JOIN lines ON phits.query_id = lines.query_id AND phits.doc_id = lines.table_id GROUP BY 1"""
        .replace("SELECT query_id, string_agg", "SELECT phits.query_id AS query_id, string_agg"),
    ),
)
def f2(t):
    tables = Space(table_catalog(t, embed))
    columns = Space(column_catalog(t, embed), parent_col="table_id")
    first, second = cx.search_sql_context(
        questions(t), tables, columns, parent_filters=table_filter(), child_filters=column_filter()
    )
    table_fields = ["full_table_name", "table_name", *cx.TABLE_BLOCK.values(), *cx.TABLE_BLOCK_LISTS.values()]
    column_fields = ["full_column_name", "column_name", "data_type", "semantic_type", "metric_role", "column_desc"]
    return cx.render_schema_context(
        with_fields(first, tables, table_fields),
        with_fields(second.drop("table_id"), columns, ["table_id", *column_fields]),
        "doc_id",
        "table_id",
    )


@query(
    "f3_render_templates",
    _catalog_sql(
        TEMPLATE_DOCS,
        (),
        "live",
        "live",
        3,
        """SELECT query_id, string_agg('[Template ' || rk || ']' || chr(10) || 'Code: t' || p_partkey || chr(10)
          || 'Name: ' || p_name || ' load ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10)
          || 'Domain: ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || chr(10)
          || 'Description: moves ' || p_name || ' ' || p_type || ' rows' || chr(10)
          || 'Required Slots: ' || CASE WHEN p_size % 2 = 0 THEN '["source_table", "target_table"]'
             ELSE '["source_table", "target_table", "schedule"]' END || chr(10)
          || 'Optional Slots: []' || chr(10) || 'Slot Schema: {}' || chr(10)
          || 'Compatibility: {}' || chr(10) || 'Default Payload: {"mode":"' || p_type || '"}',
          chr(10) || chr(10) ORDER BY rk) AS context
        FROM hits JOIN part ON doc_id = 'template::' || p_partkey GROUP BY 1""",
    ),
)
def f3(t):
    space = Space(template_catalog(t, embed))
    hits = hybrid_search(questions(t), space, cx.TEMPLATE_HITS, filters=template_filter())
    return cx.render_templates(with_fields(hits, space, space.rows.columns))
