"""SQL fragments (DuckDB dialect) shared by the oracle texts."""

from __future__ import annotations

from metaquarry.functions import text as tx
from metaquarry.sources import metadata as md

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{tx.BLANKS}+|{tx.BLANKS}+$', '', 'g')"


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(quote(v) for v in value) + "]"
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select.strip()


def counted(p: str, docs: str, carried: str = "") -> str:
    """Postings and statistics of docs(doc_id, txt, carried...) under prefix p."""
    more = f", {carried}" if carried else ""
    return f"""
{p}docs AS ({docs}),
{p}len AS (SELECT doc_id{more}, len({tokens("txt")}) AS doc_len FROM {p}docs),
{p}tf AS (SELECT doc_id, term, count(*) AS tf FROM
  (SELECT doc_id, unnest({tokens("txt")}) AS term FROM {p}docs) GROUP BY 1, 2),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}stat AS (SELECT count(*) AS n, avg(doc_len) AS a FROM {p}len)"""


def bm25(p: str, queries: str, where: str = "TRUE", allowed: str = "") -> str:
    """{p}sparse(query_id, doc_id, sparse) over counted(p) for queries(query_id, txt)."""
    return f"""
{p}qt AS (SELECT DISTINCT query_id, unnest({tokens("txt")}) AS term FROM ({queries})),
{p}sparse AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))), 4) AS sparse
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term) JOIN {p}len USING (doc_id) {allowed}, {p}stat
  WHERE {where} GROUP BY 1, 2)"""


def ranked(name: str, source: str, score: str, k: int, ident: str = "doc_id") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY {score} DESC, {ident}) AS rk FROM {source}) WHERE rk <= {k})"""


def dense(p: str, queries: str, vectors: str, where: str = "TRUE", allowed: str = "") -> str:
    """{p}cos(query_id, doc_id, cosine) of queries(query_id, qv) and vectors(doc_id, v)."""
    return f"""
{p}qv AS ({queries}),
{p}v AS ({vectors}),
{p}cos AS (SELECT query_id, doc_id, round(coalesce(list_dot_product(qv, v)
    / nullif(sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)), 0), 0), 6) AS cosine
  FROM {p}qv, {p}v {allowed} WHERE {where})"""


def hashed(p: str, source: str, dim: int, key: str = "doc_id") -> str:
    """{p}emb(key, v): hashed token counts of source(key, txt), unit length, 4-byte floats."""
    return f"""
{p}hs AS ({source}),
{p}hb AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c
  FROM (SELECT {key}, unnest({tokens("txt")}) AS term FROM {p}hs) GROUP BY 1, 2),
{p}hn AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {p}hb GROUP BY 1),
{p}emb AS (SELECT {key}, list((coalesce(c / norm, 0))::FLOAT::DOUBLE ORDER BY b) AS v
  FROM (SELECT DISTINCT {key} FROM {p}hs) CROSS JOIN (SELECT unnest(range({dim})) AS b)
  LEFT JOIN {p}hb USING ({key}, b) LEFT JOIN {p}hn USING ({key}) GROUP BY 1)"""


def fused(p: str, k: int, mult: int = 5) -> str:
    """{p}hits: hybrid top k from {p}sparse and {p}cos."""
    w = k * mult
    return f"""
{ranked(p + "s5", p + "sparse", "sparse", w)},
{ranked(p + "d5", p + "cos", "cosine", w)},
{p}joined AS (
  SELECT query_id, doc_id, cosine, sparse,
    round(0.6 * coalesce((1 + cosine) / 2, 0) + 0.4 * coalesce(2 / pi() * atan(sparse), 0), 8) AS score
  FROM (SELECT query_id, doc_id, cosine FROM {p}d5) FULL JOIN (SELECT query_id, doc_id, sparse FROM {p}s5)
    USING (query_id, doc_id)),
{ranked(p + "hits", p + "joined", "score", k)}"""


def pick(values: list[str], number: str) -> str:
    return f"list_extract({quote(values)}, ({number}) % {len(values)} + 1)"


def _described(labels: dict[str, str]) -> str:
    lines = []
    for name, label in labels.items():
        value = f"(CASE WHEN {name} THEN '{tx.YES}' ELSE '{tx.NO}' END)" if name.startswith("is_") else name
        lines.append(f"'{label}' || {value}")
    return "chr(10) || " + " || chr(10) || ".join(lines) + " || chr(10)"


RAW_TABLES = f"""
raw_tables AS (
  SELECT *, {_described(tx.TABLE_LABELS)} AS text FROM (
    SELECT p_partkey AS table_no,
      substr(domain, 1, 2) || '_table_' || p_partkey AS table_name,
      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'dw' END AS schema_name,
      CASE WHEN p_partkey % 10 = 0 THEN 'legacy' END AS database_name,
      domain || ' facts about ' || p_name || ' ' || p_type AS table_comment,
      domain AS business_domain,
      {pick(md.SYSTEMS, "p_partkey * 104729")} AS data_source,
      (p_partkey * 31) % 3 = 0 AS is_fact_table
    FROM (SELECT *, {pick(md.DOMAINS, "p_partkey * 7919")} AS domain FROM part)))"""

RAW_COLUMNS = f"""
raw_columns AS (
  SELECT *, {_described(tx.COLUMN_LABELS)} AS text FROM (
    SELECT table_no, j AS column_no, table_name,
      CASE WHEN j = 4 THEN 'changed_at' ELSE 'col_' || j END AS column_name,
      {pick(md.MEASURES, "table_no + j")} || ' field ' || j AS column_comment,
      {pick(md.COLUMN_TYPES, "table_no + j * 3")} AS data_type,
      j = 1 AS is_primary_key,
      (table_no + j) % 4 = 0 AS is_foreign_key,
      (table_no + j) % 3 <> 0 AS is_nullable,
      {pick(md.MEASURES, "table_no + j")} || ' field ' || j || ' of ' || table_comment AS business_meaning,
      {pick(md.MEASURES, "table_no + j")} AS metric_type,
      {quote(md.ENUM_TEXT)} AS enum_values
    FROM (SELECT table_no, table_name, table_comment,
      unnest(range(1, (8 + (table_no * 6151) % 13 + 1)::BIGINT)) AS j FROM raw_tables)))"""

SCHEMA_OF = "coalesce(nullif(schema_name, ''), nullif(database_name, ''), 'default')"
SEMANTIC = """CASE WHEN is_primary_key THEN 'ID'
  WHEN data_type LIKE '%time%' OR data_type LIKE '%date%' OR column_name LIKE '%\\_at' ESCAPE '\\' THEN 'TIME'
  WHEN regexp_matches(data_type, 'int|decimal|double|float|bigint') THEN 'METRIC'
  ELSE 'DIMENSION' END"""
TABLE_TEXT = strip(
    "text || chr(10) || table_name || chr(10) || table_comment || chr(10) || business_domain || chr(10) || data_source"
)
COLUMN_TEXT = strip(
    "text || chr(10) || column_name || chr(10) || column_comment || chr(10) || business_meaning"
    " || chr(10) || metric_type || chr(10) || enum_values"
)

TABLE_CATALOG = f"""
table_catalog AS (
  SELECT 'table::' || {SCHEMA_OF} || '::' || table_name AS doc_id,
    coalesce(nullif(schema_name, ''), 'default') AS schema_of,
    coalesce(nullif(schema_name, ''), 'default') || '.' || table_name AS full_table_name,
    {TABLE_TEXT} AS search_text, *
  FROM raw_tables)"""

COLUMN_CATALOG = f"""
column_catalog AS (
  SELECT 'column::' || schema_of || '::' || table_name || '::' || column_name AS doc_id,
    'table::' || schema_of || '::' || table_name AS table_id,
    schema_of || '.' || table_name || '.' || column_name AS full_column_name,
    {SEMANTIC} AS semantic_type, {COLUMN_TEXT} AS search_text, *
  FROM raw_columns JOIN (SELECT table_name, {SCHEMA_OF} AS schema_of, data_source AS source_of FROM raw_tables)
    USING (table_name))"""
