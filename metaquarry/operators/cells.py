"""Vector index of coarse cells: fewer vectors are read, not only fewer compared.

Centres are fitted on a bounded sample. Every vector is stored in the folder of the cell whose
centre has the highest cosine with it, a large cell in several files. A search reads only the
folders of the cells nearest to its queries and compares each query with the vectors of its own
cells, exactly.

Centres and cells are computed from vectors rounded to integers, so sums are the same in any
order and any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.operators.blocks import RunningTopK
from metaquarry.operators.knn import (
    SHIP_RESULTS,
    _add_steps,
    _ids,
    _known,
    _result_schema,
    _shippable,
    _unit,
    knn_within,
)
from metaquarry.operators.topk import top_k
from metaquarry.session import ship_package

#: Vectors are multiplied by this and rounded down after adding a half.
GRID = 1 << 20
#: Rows of the sample that centres are fitted on, at most.
SAMPLE_ROWS = 20_000
ROUNDS = 2
#: Files that a cell's vectors are written to, at most, by one task each.
SLICES = 8


def on_grid(column) -> np.ndarray:
    """Whole numbers as doubles; products of two vectors on the grid stay exact."""
    return np.floor(np.stack([np.asarray(v, np.float64) for v in column]) * GRID + 0.5)


def _closeness(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Order of the cosine with each centre; a centre without length is never near."""
    lengths = np.sqrt((centres * centres).sum(axis=1))
    return rows @ centres.T / np.where(lengths == 0, np.inf, lengths)


def nearest_cells(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first, ties to the lower number."""
    return np.argsort(-_closeness(rows, centres), axis=1, kind="stable")[:, :n]


def fit_centres(vectors: DataFrame, id_col: str, vector_col: str, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (cells, dim) from the SAMPLE_ROWS vectors whose ids have the smallest md5.

    The first ``cells`` of them are the start; in every round a centre moves to the mean of
    the sample's vectors that are nearest to it, or stays if there are none.
    """
    known = vectors.filter(F.col(vector_col).isNotNull())
    order = [F.md5(F.col(id_col).cast("string")), F.col(id_col)]
    sample = on_grid(known.orderBy(*order).limit(SAMPLE_ROWS).select(vector_col).toPandas()[vector_col])
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        for cell in range(len(centres)):
            mine = sample[own == cell]
            if len(mine):
                centres[cell] = np.floor(mine.sum(axis=0) / len(mine))
    return centres


@dataclass(frozen=True)
class CellIndex:
    rows: DataFrame  # id, vector, carried columns, cell
    centres: np.ndarray
    id_col: str
    vector_col: str

    @staticmethod
    def save(
        vectors: DataFrame,
        path: str,
        *,
        id_col: str = "doc_id",
        vector_col: str = "dense_vector",
        cells: int = 256,
        rounds: int = ROUNDS,
        slices: int = SLICES,
    ) -> None:
        """Write vectors with all their columns below ``path``, by cell. Null vectors are left out."""
        spark = vectors.sparkSession
        ship_package(spark)
        known = vectors.filter(F.col(vector_col).isNotNull())
        if known.isEmpty():
            centres, placed = np.zeros((0, 0)), known.withColumn("cell", F.lit(0))
        else:
            centres = fit_centres(vectors, id_col, vector_col, cells, rounds)
            shared = spark.sparkContext.broadcast(centres)

            @F.pandas_udf("int")
            def cell_of(vector: pd.Series) -> pd.Series:
                return pd.Series(nearest_cells(on_grid(vector), shared.value, 1)[:, 0].astype(np.int32))

            placed = known.withColumn("cell", cell_of(F.col(vector_col)))
        # plain lists of floats: a frame of arrays is accepted only where Arrow conversion is on
        numbered = list(enumerate(centres.tolist()))
        spark.createDataFrame(numbered, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        (
            placed.withColumn("slice", F.pmod(F.xxhash64(id_col), F.lit(slices)))
            .repartition("cell", "slice")
            .drop("slice")
            .write.partitionBy("cell")
            .parquet(f"{path}/vectors")
        )

    @staticmethod
    def load(vectors_like: DataFrame, path: str, id_col: str = "doc_id", vector_col: str = "dense_vector") -> "CellIndex":
        """The index below ``path``; ``vectors_like`` gives the columns it was saved with."""
        spark = vectors_like.sparkSession
        schema = T.StructType([*vectors_like.schema.fields, T.StructField("cell", T.IntegerType())])
        rows = spark.read.schema(schema).parquet(f"{path}/vectors")
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return CellIndex(rows, np.array([r["centre"] for r in found], np.float64), id_col, vector_col)


def knn_cells(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    *,
    probes: int,
    where: Column | None = None,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    exclude_same: bool = False,
    ship: bool = True,
) -> DataFrame:
    """The k best vectors among those of the ``probes`` cells nearest to each query.

    query_id, id, cosine, rk. ``where`` is a condition on the stored columns. Queries without a
    vector find nothing. Few queries are shipped to the tasks that read their cells; many are
    dealt to cells and meet the vectors there, in blocks of bounded size.
    """
    spark = queries.sparkSession
    ship_package(spark)
    id_col, vector_col = index.id_col, index.vector_col
    schema = _result_schema(queries, query_id, index.rows, id_col)
    rows = index.rows if where is None else index.rows.where(where)
    qs = queries.select(query_id, query_vector)
    none = spark.createDataFrame([], schema).withColumn("rk", F.lit(1))
    if not len(index.centres):
        return none
    head = _shippable(qs) if ship else None
    if head is not None and len(head) * k <= SHIP_RESULTS:
        if head.empty:
            return none
        near = nearest_cells(on_grid(head.iloc[:, 1]), index.centres, probes)
        asked = {int(cell): np.flatnonzero((near == cell).any(axis=1)) for cell in np.unique(near)}
        shared = spark.sparkContext.broadcast((_ids(head.iloc[:, 0]), _unit(head.iloc[:, 1]), asked))

        def scan(batches):
            q_ids, q_unit, asked = shared.value
            best: dict[int, RunningTopK] = {}
            for pdf in batches:
                for cell, part in pdf.groupby("cell", sort=False):
                    who = asked[int(cell)]
                    held = best.setdefault(int(cell), RunningTopK(len(who), k))
                    found, unit = _ids(part.iloc[:, 0]), _unit(part.iloc[:, 1])
                    _add_steps(held, q_ids[who], q_unit[who], found, unit, exclude_same)
            for cell, held in best.items():
                out = held.frame(q_ids[asked[cell]], query_id, id_col, "cosine")
                if out is not None:
                    yield out

        read = rows.where(F.col("cell").isin(sorted(asked))).select(id_col, vector_col, "cell")
        return top_k(read.mapInPandas(scan, schema), query_id, "cosine", k, id_col)

    shared = spark.sparkContext.broadcast(index.centres)

    @F.pandas_udf("array<int>")
    def cells_of(vector: pd.Series) -> pd.Series:
        known = vector[vector.notna()]
        out = pd.Series([None] * len(vector), index=vector.index, dtype=object)
        if len(known):
            near = nearest_cells(on_grid(known), shared.value, probes).astype(np.int32)
            out[known.index] = pd.Series(list(near), index=known.index)
        return out

    # explode_outer: for explode Spark would first filter on the cells, computing them twice
    dealt = qs.withColumn("cell", F.explode_outer(cells_of(F.col(query_vector))))
    partial = knn_within(
        dealt, rows, k, "cell", query_id=query_id, query_vector=query_vector, id_col=id_col,
        vector_col=vector_col, exclude_same=exclude_same,
    )
    return top_k(partial, query_id, "cosine", k, id_col)
