"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order of its
nearest pivots, and posted in the inverted file of each of them together with the place the
pivot has in its order. A query reads the files of its own nearest pivots, which gives the
footrule distance of the two orders to every vector posted there; the vectors of smallest
distance are reranked by the exact inner product. The index is split into slices by row,
queries go through them in blocks, and each slice keeps its best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import query, stored, table
from metaquarry.session import ship_package

#: Pivots of a dimension, at most; they are the vectors of the smallest id hashes.
PIVOTS = 256
#: Pivots that represent a vector.
ORDER = 64
#: Vectors of a slice, about; share of a slice that is reranked, and least number of vectors.
SLICE_ROWS, RERANK_SHARE, RERANK_LEAST = 16_384, 0.2, 400
#: Of the reranked, so many are the longest of the slice, whatever their direction.
LONGEST = 32
#: Queries that go through a slice together.
BLOCK_QUERIES = 4_096
#: The registered query's share of rows that are queries.
QUERY_EVERY = 20


def usable(vector) -> F.Column:
    """Vectors that are not null, empty or zero and whose components are all finite."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """Numbers of the ``order`` pivots of largest cosine, nearest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ pivots.T
    order = min(order, len(pivots))
    some = np.argpartition(-score, order - 1, axis=1)[:, :order]
    rank = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, rank, 1)


class InvertedFiles:
    """Postings of one slice: for each pivot the vectors near it, and their places."""

    def __init__(self, ids: np.ndarray, lines: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        first = np.lexsort((lines, ids))
        self.ids, self.lines, self.vectors, self.pivots = ids[first], lines[first], vectors[first], pivots
        orders = nearest_pivots(self.vectors, pivots, ORDER)
        self.order = orders.shape[1]
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.order).astype(np.int32)
        self.places = (by % self.order).astype(np.int32)
        self.begin = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        norms = np.linalg.norm(self.vectors, axis=1)
        self.longest = np.argsort(-norms, kind="stable")[:LONGEST]
        self.rerank = max(RERANK_LEAST, int(RERANK_SHARE * len(ids)))

    def search(self, line: int, vector: np.ndarray, order: np.ndarray, k: int):
        """(ids, scores) of the best k of the slice; ``line`` is the query's own row."""
        # footrule: a pivot missing in one of the orders counts as standing behind all others
        gain = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(order):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            rows, places = self.rows[a:b], self.places[a:b]
            gain[rows] += (self.order - place) + (self.order - places) - np.abs(places - place)
        n = self.rerank
        if n < len(gain):
            least = np.partition(gain, len(gain) - n)[len(gain) - n]
            sure = np.flatnonzero(gain > least)
            near = np.concatenate((sure, np.flatnonzero(gain == least)[: n - len(sure)], self.longest))
            near = np.unique(near)
        else:
            near = np.arange(len(gain))
        near = near[self.lines[near] != line]
        scores = (self.vectors[near] * vector).sum(axis=1)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near][best], scores[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _search(k: int, shared):
    """One slice's index against one block of queries."""

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query_line": [], "vec_id": [], "score": []})
        pivots = shared.value[key[0]]
        index = InvertedFiles(left["vec_id"].to_numpy(), left["line"].to_numpy(), _matrix(left["vector"]), pivots)
        vectors = _matrix(right["query_vector"])
        orders = nearest_pivots(vectors, pivots, ORDER)
        found = [index.search(q, v, o, k) for q, v, o in zip(right["query_line"], vectors, orders, strict=True)]
        sizes = [len(f[0]) for f in found]
        return pd.DataFrame(
            {
                "query_id": np.repeat(right["query_vec_id"].to_numpy(), sizes),
                "query_line": np.repeat(right["query_line"].to_numpy(), sizes),
                "vec_id": np.concatenate([f[0] for f in found]),
                "score": np.concatenate([f[1] for f in found]),
            }
        )

    return search


def _pivots(sample: list) -> dict[int, np.ndarray]:
    by: dict[int, list[np.ndarray]] = {}
    for row in sample:
        v = np.array(row["vector"], np.float64)
        by.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {dim: np.stack(vs) for dim, vs in by.items()}


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part. A query
    meets vectors of its own dimension only, and every row of it but its own. Rows that repeat
    an id are rows of their own: each is found, and each that is a query has its own k rows.
    Rows without an id take no part. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    own = own.withColumns({"dim": F.size("vector"), "line": F.monotonically_increasing_id()})
    own = stored(own, "vectors")
    # a bounded sample: at most PIVOTS rows of each dimension reach the driver
    hashed = Window.partitionBy("dim").orderBy(F.md5(F.col("vec_id").cast("string")), "line")
    sample = own.withColumn("n", F.row_number().over(hashed)).filter(F.col("n") <= PIVOTS).collect()
    shared = spark.sparkContext.broadcast(_pivots(sample))
    queries = own.filter(is_query(F.col("vec_id")))

    def parts(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    # both sides know how many slices and blocks their dimension has
    cuts = F.broadcast(
        stored(parts(own, "slices", SLICE_ROWS).join(parts(queries, "blocks", BLOCK_QUERIES), "dim"), "cuts")
    )

    def dealt(df: DataFrame, own_part: str, own_count: str, other_part: str, other_count: str) -> DataFrame:
        return df.join(cuts, "dim").select(
            "dim",
            "vec_id",
            "line",
            "vector",
            F.pmod(F.xxhash64("line"), F.col(own_count)).cast("int").alias(own_part),
            F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other_part),
        )

    asked = dealt(queries, "block", "blocks", "slice", "slices")
    asked = asked.toDF(*[f"query_{c}" for c in asked.columns])
    found = (
        dealt(own, "slice", "slices", "block", "blocks")
        .groupBy("dim", "slice", "block")
        .cogroup(asked.groupBy("query_dim", "query_slice", "query_block"))
        .applyInPandas(_search(k, shared), "query_id long, query_line long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "query_line").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


@query("op4_permutation_index")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % QUERY_EVERY == 0)
