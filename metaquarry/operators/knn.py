"""Cosine nearest neighbours without a cross join.

Vectors are compared in numpy blocks inside Spark tasks; a task hands on only its best k
per query, never all pairs. Which side travels is decided by measured size:

* few queries: they are shipped to every task of the vector scan; nothing else is shuffled;
* few vectors: they are shipped to every task of the query scan; rows are final at once;
* both large: both sides are cut into blocks that meet by an equi-join on the block numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metaquarry.operators.blocks import DENSE_DIGITS, RunningTopK
from metaquarry.operators.topk import top_k
from metaquarry.session import cut_lineage, ship_package

# What may be shipped to every task: rows, and values (rows x dimension; 8 bytes each).
SHIP_ROWS, SHIP_VALUES = 20_000, 8_000_000
# Results one task of the vector scan may hand on: queries x k.
SHIP_RESULTS = 1_000_000
BLOCK_ROWS = 20_000
# Scores held at once in a task (32 MB).
STEP_CELLS = 4_000_000
# From one pair in so many on, all pairs are multiplied at once.
DENSE_SHARE = 64


def _unit(column) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _ids(column) -> np.ndarray:
    return np.asarray(column.tolist())


def _unit_lists(column: pa.ListArray) -> np.ndarray:
    """The same of an Arrow column without nulls."""
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    if (column.value_lengths().to_numpy(zero_copy_only=False) != m.shape[1]).any():
        raise ValueError("vectors of different lengths")
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _scores(q_ids, q_unit, v_ids, v_unit, exclude_same: bool) -> np.ndarray:
    """Cosines; RunningTopK rounds those it keeps."""
    scores = q_unit @ v_unit.T
    if exclude_same:
        scores[q_ids[:, None] == v_ids[None, :]] = -np.inf
    return scores


def _known(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows whose vector (second column) is there."""
    return pdf[pdf.iloc[:, 1].notna()]


def _shippable(df: DataFrame) -> pd.DataFrame | None:
    """The rows of ``df`` if their number and size are within bounds; reads no more."""
    head = _known(df.limit(SHIP_ROWS + 1).toPandas())
    if len(head) > SHIP_ROWS or sum(len(v) for v in head.iloc[:, 1]) > SHIP_VALUES:
        return None
    return head


def _result_schema(queries, query_id, vectors, id_col) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id_col, vectors.schema[id_col].dataType),
            T.StructField("cosine", T.DoubleType()),
        ]
    )


def knn_exact(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    id_col: str = "doc_id",
    vector_col: str = "dense_vector",
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
    ship: bool = True,
) -> DataFrame:
    """The k vectors with the highest cosine per query: query_id, id, cosine, rk."""
    ship_package(queries.sparkSession)
    schema = _result_schema(queries, query_id, vectors, id_col)
    # null vectors are dropped where batches are read: a filter here would make Spark
    # compute an encoder's output twice
    qs = queries.select(query_id, query_vector)
    vs = vectors.select(id_col, vector_col)
    head = _shippable(qs) if ship else None
    if head is not None and len(head) * k <= SHIP_RESULTS:
        if head.empty:
            spark = queries.sparkSession
            return spark.createDataFrame([], schema).withColumn("rk", F.lit(1))
        partial = _scan_vectors(vs, head, k, query_id, id_col, schema, exclude_same)
        return top_k(partial, query_id, "cosine", k, id_col)
    head = _shippable(vs) if ship else None
    if head is not None and not head.empty:
        return _scan_queries(qs, head, k, query_id, id_col, schema, exclude_same)
    one = F.lit(0)
    partial = knn_within(
        qs.withColumn("_key", one),
        vs.withColumn("_key", one),
        k,
        "_key",
        query_id=query_id,
        query_vector=query_vector,
        id_col=id_col,
        vector_col=vector_col,
        exclude_same=exclude_same,
        block_rows=block_rows,
    )
    return top_k(partial, query_id, "cosine", k, id_col)


def _add_steps(best: RunningTopK, q_ids, q_unit, v_ids, v_unit, exclude_same) -> None:
    """Scores of all pairs, in blocks of at most STEP_CELLS."""
    step = max(1, STEP_CELLS // max(1, len(q_ids)))
    for at in range(0, len(v_ids), step):
        ids = v_ids[at : at + step]
        best.add(_scores(q_ids, q_unit, ids, v_unit[at : at + step], exclude_same), ids)


def _scan_vectors(vs, head, k, query_id, id_col, schema, exclude_same) -> DataFrame:
    q_ids, q_unit = _ids(head.iloc[:, 0]), _unit(head.iloc[:, 1])
    shipped = vs.sparkSession.sparkContext.broadcast((q_ids, q_unit))

    def scan(batches):
        ids, unit = shipped.value
        best = RunningTopK(len(ids), k)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows:
                found, rows = np.asarray(batch.column(0).to_pylist()), _unit_lists(batch.column(1))
                _add_steps(best, ids, unit, found, rows, exclude_same)
        out = best.frame(ids, query_id, id_col, "cosine")
        if out is not None:
            yield pa.RecordBatch.from_pandas(out, schema=to_arrow_schema(schema), preserve_index=False)

    # lists of numbers come as one block, not as an object for each row
    return vs.mapInArrow(scan, schema)


def _scan_queries(qs, head, k, query_id, id_col, schema, exclude_same) -> DataFrame:
    v_ids, v_unit = _ids(head.iloc[:, 0]), _unit(head.iloc[:, 1])
    shipped = qs.sparkSession.sparkContext.broadcast((v_ids, v_unit))

    def scan(batches):
        ids, unit = shipped.value
        for pdf in map(_known, batches):
            if pdf.empty:
                continue
            q_ids = _ids(pdf.iloc[:, 0])
            best = RunningTopK(len(q_ids), k)
            _add_steps(best, q_ids, _unit(pdf.iloc[:, 1]), ids, unit, exclude_same)
            out = best.frame(q_ids, query_id, id_col, "cosine")
            out["rk"] = out.groupby(query_id, sort=False).cumcount().astype("int32") + 1
            yield out

    return qs.mapInPandas(scan, T.StructType([*schema.fields, T.StructField("rk", T.IntegerType())]))


def knn_within(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    key: str,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    id_col: str = "doc_id",
    vector_col: str = "dense_vector",
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each key both sides share, the best k per query within that key, partially
    reduced: a query met in several keys or blocks has up to k rows from each.

    A key with more than ``block_rows`` rows on a side is split into blocks, and small
    blocks are packed together, so tasks stay of even size whatever the key sizes are.
    """
    ship_package(queries.sparkSession)
    qs = queries.select(query_id, query_vector, key)
    vs = vectors.select(id_col, vector_col, key)
    n_v = vs.groupBy(key).agg(F.count(F.lit(1)).alias("_nv"))
    n_q = qs.groupBy(key).agg(F.count(F.lit(1)).alias("_nq"))
    cuts = n_v.join(n_q, key).select(
        key,
        F.ceil(F.col("_nv") / block_rows).cast("int").alias("_cv"),
        F.ceil(F.col("_nq") / block_rows).cast("int").alias("_cq"),
        (F.col("_nv") + F.col("_nq")).alias("_rows"),
    )
    # a row per key, used three times: both sides are read once for it
    cuts = cut_lineage(cuts)
    # rows after replication, to choose how many packs of about block_rows rows to make
    total = cuts.agg(F.sum(F.col("_rows") * F.greatest("_cv", "_cq"))).first()[0] or 0
    partitions = int(qs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = max(partitions, int(total // block_rows) + 1)

    def placed(df, own, own_cut, other, other_cut, ident):
        block = F.pmod(F.xxhash64(ident), F.col(own_cut)).cast("int")
        return (
            df.join(cuts, key)
            .withColumn(own, block)
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_cut) - 1)))
            .withColumn("_pack", F.pmod(F.xxhash64(key, "_vb", "_qb"), F.lit(packs)))
            .drop("_cv", "_cq", "_rows")
        )

    v_side = placed(vs, "_vb", "_cv", "_qb", "_cq", id_col)
    q_side = placed(qs, "_qb", "_cq", "_vb", "_cv", query_id)
    parts = [key, "_vb", "_qb"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = _known(left), _known(right)
        blocks = dict(tuple(right.groupby(parts, sort=False)))
        out = [pd.DataFrame({query_id: [], id_col: [], "cosine": []})]
        for name, q in left.groupby(parts, sort=False):
            v = blocks.get(name)
            if v is not None:
                q_ids, v_ids = _ids(q[query_id]), _ids(v[id_col])
                q_unit, v_unit = _unit(q[query_vector]), _unit(v[vector_col])
                best = RunningTopK(len(q_ids), k)
                _add_steps(best, q_ids, q_unit, v_ids, v_unit, exclude_same)
                out.append(best.frame(q_ids, query_id, id_col, "cosine"))
        return pd.concat(out[1:] or out, ignore_index=True)

    schema = _result_schema(queries, query_id, vectors, id_col)
    return q_side.groupBy("_pack").cogroup(v_side.groupBy("_pack")).applyInPandas(meet, schema)


#: Vectors are multiplied by this and rounded to whole numbers before they are hashed.
GRID = 1 << 20


def hyperplanes(dim: int, n: int) -> np.ndarray:
    """``n`` hyperplanes with whole coefficients, made of md5 digits so any engine can make them."""
    digits = [[hashlib.md5(f"{p}:{d}".encode()).hexdigest()[:4] for d in range(dim)] for p in range(n)]
    return np.array([[int(x, 16) - 32_768 for x in row] for row in digits], np.float64)


def _sides(column, planes: np.ndarray) -> np.ndarray:
    """Products with all planes; whole numbers, so exact in any order."""
    rows = np.stack([np.asarray(v, np.float64) for v in column])
    return np.floor(rows * GRID + 0.5) @ planes.T


def bucket_keys(column, planes: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables): which side of its table's planes a vector is on, as a number."""
    bits = len(planes) // tables
    sides = _sides(column, planes).reshape(-1, tables, bits) > 0
    return sides @ (1 << np.arange(bits)) + (np.arange(tables) << bits)


def probe_keys(column, planes: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes): the own bucket, then those across the nearest planes."""
    bits = len(planes) // tables
    products = _sides(column, planes)
    far = (np.abs(products) / np.sqrt((planes * planes).sum(axis=1))).reshape(-1, tables, bits)
    own = (products.reshape(-1, tables, bits) > 0) @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
    near = np.argsort(far, axis=2, kind="stable")[:, :, :probes]
    return np.concatenate((own[:, :, None], own[:, :, None] ^ (1 << near)), axis=2)


def _met_scores(met: np.ndarray, q_unit: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Cosines where ``met`` (queries x vectors) is set, else -inf.

    Copying both vectors of every pair that met would take many times the memory of the
    scores. So pairs are taken a few at a time, and where many met all are multiplied.
    """
    if np.count_nonzero(met) * DENSE_SHARE > met.size:
        return np.where(met, np.round(q_unit @ unit.T, DENSE_DIGITS), -np.inf)
    scores = np.full(met.shape, -np.inf)
    q, v = np.nonzero(met)
    step = max(1, STEP_CELLS // max(1, q_unit.shape[1]))
    for at in range(0, len(q), step):
        a, b = q[at : at + step], v[at : at + step]
        scores[a, b] = np.round(np.einsum("ij,ij->i", q_unit[a], unit[b]), DENSE_DIGITS)
    return scores


def _scan_buckets(vs, head, k, query_id, id_col, schema, exclude_same, planes, tables, probes) -> DataFrame:
    """Vectors meet the queries of their buckets where they are read."""
    q_ids, q_unit = _ids(head.iloc[:, 0]), _unit(head.iloc[:, 1])
    bits = len(planes) // tables
    asked = np.zeros((tables << bits, len(q_ids)), bool)
    for q, keys in enumerate(probe_keys(head.iloc[:, 1], planes, tables, probes)):
        asked[keys.ravel(), q] = True
    shipped = vs.sparkSession.sparkContext.broadcast((q_ids, q_unit, planes, np.packbits(asked, axis=1)))

    def scan(batches):
        q_ids, q_unit, planes, asked = shipped.value
        best = RunningTopK(len(q_ids), k)
        step = max(1, STEP_CELLS // len(q_ids))
        for pdf in map(_known, batches):
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                keys = bucket_keys(part.iloc[:, 1], planes, tables)
                met = np.bitwise_or.reduce(asked[keys], axis=1)  # of all tables
                met = np.unpackbits(met, axis=1, count=len(q_ids)).astype(bool).T
                found, unit = _ids(part.iloc[:, 0]), _unit(part.iloc[:, 1])
                if exclude_same:
                    met &= q_ids[:, None] != found[None, :]
                best.add(_met_scores(met, q_unit, unit), found)
        out = best.frame(q_ids, query_id, id_col, "cosine")
        if out is not None:
            yield out

    return vs.mapInPandas(scan, schema)


def knn_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    dim: int,
    tables: int = 6,
    bits: int = 7,
    probes: int = 3,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    id_col: str = "doc_id",
    vector_col: str = "dense_vector",
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
    ship: bool = True,
) -> DataFrame:
    """Neighbours among vectors that share a bucket with the query, ranked exactly.

    Every vector has one bucket per table: the sides of ``bits`` hyperplanes it is on. A query
    looks in its own bucket and, in the order of their distance, in those across the
    ``probes`` nearest planes. More tables and probes find more of the true neighbours; more
    bits make buckets smaller.

    Few queries are shipped, and nothing but the best rows is shuffled. Otherwise ids and
    vectors are dealt to buckets, in blocks of bounded size.
    """
    ship_package(queries.sparkSession)
    planes = hyperplanes(dim, tables * bits)
    schema = _result_schema(queries, query_id, vectors, id_col)
    qs, vs = queries.select(query_id, query_vector), vectors.select(id_col, vector_col)
    head = _shippable(qs) if ship else None
    if head is not None and len(head) * k <= SHIP_RESULTS:
        if head.empty:
            return queries.sparkSession.createDataFrame([], schema).withColumn("rk", F.lit(1))
        partial = _scan_buckets(vs, head, k, query_id, id_col, schema, exclude_same, planes, tables, probes)
        return top_k(partial, query_id, "cosine", k, id_col)

    def keyed(df, vector, keys_of):
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def keys(column: pd.Series) -> pd.Series:
            known = column[column.notna()]
            out = pd.Series([None] * len(column), index=column.index, dtype=object)
            if len(known):
                out[known.index] = pd.Series(list(keys_of(known).reshape(len(known), -1)), index=known.index)
            return out

        # explode_outer: for explode Spark would first filter on the keys, computing them twice
        return df.withColumn("_key", F.explode_outer(keys(F.col(vector))))

    partial = knn_within(
        keyed(qs, query_vector, lambda c: probe_keys(c, planes, tables, probes)),
        keyed(vs, vector_col, lambda c: bucket_keys(c, planes, tables)),
        k,
        "_key",
        query_id=query_id,
        query_vector=query_vector,
        id_col=id_col,
        vector_col=vector_col,
        exclude_same=exclude_same,
        block_rows=block_rows,
    ).dropDuplicates([query_id, id_col])
    return top_k(partial, query_id, "cosine", k, id_col)


def recall(found: DataFrame, truth: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """Share of each query's true neighbours that were found."""
    hit = found.select(query_id, id_col, F.lit(1).alias("_hit"))
    return (
        truth.select(query_id, id_col)
        .join(hit, [query_id, id_col], "left")
        .groupBy(query_id)
        .agg(F.round(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"))
    )
