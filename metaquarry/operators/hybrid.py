"""Weighted fusion of BM25 and cosine search, with filters, restrictions and fallback."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.text import normalize_json
from metaquarry.operators.bm25 import Bm25Index, bm25_search
from metaquarry.operators.cells import CellIndex, knn_cells
from metaquarry.operators.filters import build_filter, conditions
from metaquarry.operators.knn import knn_exact, knn_within
from metaquarry.operators.topk import SMALL_ROWS, fits, maybe_broadcast, top_k
from metaquarry.schemas import CANDIDATE_MULT, DENSE_WEIGHT, SPARSE_WEIGHT, Catalog

# one digit more than 0.3 x a six-digit cosine has, so no score lies on a rounding border
SCORE_DIGITS = 8
#: Up to this many parents are looked up inside the row.
LISTED_PARENTS = 20_000
#: Cells that an approximate search reads for each query.
PROBES = 16


@dataclass(frozen=True)
class Space:
    """A searchable table: its rows, which columns hold id, text, vector and parent, and
    optionally a prebuilt text index (carrying the filter and parent columns).

    ``vectors`` holds the vectors where they are a table of their own, with the id and the
    filter and parent columns; text passes then never read or join them. ``cells`` is a saved
    vector index with the same columns; approximate searches read it instead. ``output`` names
    the fields a search returns unless others are asked for.
    """

    rows: DataFrame
    id_col: str = "doc_id"
    text_col: str | None = "search_text"
    vector_col: str = "dense_vector"
    parent_col: str | None = None
    index: Bm25Index | None = None
    vectors: DataFrame | None = None
    cells: CellIndex | None = None
    output: tuple[str, ...] = ()

    @staticmethod
    def of(rows: DataFrame, catalog: Catalog, **parts) -> "Space":
        """The space of a catalog's rows; a search returns the catalog's output fields."""
        names = {"id_col": catalog.key, "text_col": catalog.text_col, "vector_col": catalog.vector_col}
        return Space(rows, **{**names, "output": catalog.output, **parts})

    @property
    def vector_rows(self) -> DataFrame:
        return self.rows if self.vectors is None else self.vectors

    @property
    def has_text(self) -> bool:
        return self.index is not None or (
            self.text_col is not None and self.text_col in self.rows.columns
        )


def dense_norm(cosine: Column) -> Column:
    return (1 + cosine) / 2


def sparse_norm(score: Column) -> Column:
    return F.lit(2 / math.pi) * F.atan(score)


def normalize_scores(df: DataFrame) -> DataFrame:
    """Add both scores on a 0..1 scale; a side that did not find the row counts 0."""
    return df.withColumn(
        "dense_norm", F.coalesce(dense_norm(F.col("cosine")), F.lit(0.0))
    ).withColumn("sparse_norm", F.coalesce(sparse_norm(F.col("sparse")), F.lit(0.0)))


def _dense(queries, space: Space, k, filters, allowed, probes) -> DataFrame:
    if probes and space.cells is not None and allowed is None:
        where = build_filter(filters) if conditions(filters) else None
        return knn_cells(queries, space.cells, k, probes=probes, where=where)
    rows = space.vector_rows.where(build_filter(filters))
    if allowed is None:
        return knn_exact(queries, rows, k, id_col=space.id_col, vector_col=space.vector_col)
    keyed = queries.select("query_id", "query_vector").join(
        allowed.select("query_id", space.parent_col), "query_id"
    )
    parents = allowed.select(space.parent_col).distinct()
    known = parents.limit(LISTED_PARENTS + 1).collect()
    if len(known) <= LISTED_PARENTS:
        # a filter, unlike a join, is applied before the rows are encoded
        rows = rows.where(F.col(space.parent_col).isin([r[0] for r in known if r[0] is not None]))
    else:
        rows = rows.join(parents, space.parent_col, "left_semi")
    partial = knn_within(
        keyed,
        rows,
        k,
        space.parent_col,
        id_col=space.id_col,
        vector_col=space.vector_col,
    )
    return top_k(partial, "query_id", "cosine", k, space.id_col)


def hybrid_search(
    queries: DataFrame,
    space: Space,
    k: int,
    *,
    filters: dict[str, Any] | None = None,
    allowed: DataFrame | None = None,
    weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT),
    multiplier: int = CANDIDATE_MULT,
    exact_dense: bool = True,
    probes: int = PROBES,
) -> DataFrame:
    """Top k per query: query_id, id, cosine, sparse, score, rk.

    ``queries`` has query_id, query_text and query_vector. Each branch finds
    ``multiplier * k`` candidates among the filtered rows. ``allowed`` (query_id, parent)
    restricts every query to its own parents. A space without text is searched by vector
    alone, and its score is the plain cosine. With ``exact_dense=False`` the vector branch of
    a space with ``cells`` looks in the ``probes`` cells nearest to each query only; searches
    restricted by ``allowed`` stay exact, as they look at few rows anyway.
    """
    probes = 0 if exact_dense else probes
    if not space.has_text:
        found = _dense(queries, space, k, filters, allowed, probes)
        return found.select(
            "query_id",
            space.id_col,
            "cosine",
            F.lit(None).cast("double").alias("sparse"),
            F.col("cosine").alias("score"),
            "rk",
        )
    width = max(k * multiplier, k)
    dense = _dense(queries, space, width, filters, allowed, probes).drop("rk")
    filter_cols = tuple(conditions(filters))
    sparse = bm25_search(
        queries,
        space.index or space.rows,
        width,
        id_col=space.id_col,
        text_col=space.text_col,
        carried=filter_cols,
        where=build_filter(filters) if filter_cols else None,
        allowed=allowed,
        parent=space.parent_col if allowed is not None else None,
    ).drop("rk")
    both = normalize_scores(dense.join(sparse, ["query_id", space.id_col], "full_outer"))
    w_dense, w_sparse = weights
    fused = F.round(w_dense * F.col("dense_norm") + w_sparse * F.col("sparse_norm"), SCORE_DIGITS)
    ranked = top_k(both.withColumn("score", fused), "query_id", "score", k, space.id_col)
    hits = ranked.select("query_id", space.id_col, "cosine", "sparse", "score", "rk")
    # at most k hits per query: with few queries, joins to the wide rows need not shuffle them
    few = fits(queries.select("query_id"), SMALL_ROWS // k)
    return maybe_broadcast(hits, few)


def with_fields(hits: DataFrame, space: Space, fields: list[str]) -> DataFrame:
    """Join the wide columns back, after ranking: those of ``fields`` the rows really have.

    ``hybrid_search`` marks hits of few queries for broadcast, so the rows are not shuffled.
    """
    have = [f for f in fields if f in space.rows.columns and f != space.id_col]
    rows = space.rows.select(space.id_col, *have)
    return rows.join(hits, space.id_col)


def normalize_hit(hits: DataFrame, fields: list[str], key: str = "query_id") -> DataFrame:
    """Requested fields that exist, and ``score`` from score, else distance, else 0."""
    have = [f for f in fields if f in hits.columns]
    sources = [F.col(c).cast("double") for c in ("score", "distance") if c in hits.columns]
    return hits.select(key, *have, F.coalesce(*sources, F.lit(0.0)).alias("score"))


def summarize_hits(hits: DataFrame, fields: list[str]) -> Column:
    """JSON object of the non-null fields and the score with six digits."""
    have = [F.col(f) for f in fields if f in hits.columns]
    score = F.round(F.coalesce(F.col("score"), F.lit(0.0)), 6).alias("score")
    return F.to_json(F.struct(*have, score))


def with_json(hits: DataFrame, fields: list[str]) -> DataFrame:
    """Text fields as VARIANT: the value of those that are JSON as a whole, else the text; nulls stay."""
    texts = [f for f in fields if f in hits.columns and hits.schema[f].dataType.simpleString() == "string"]
    return hits.withColumns({f: F.when(F.col(f).isNotNull(), normalize_json(F.col(f))) for f in texts})


def search(
    queries: DataFrame,
    space: Space,
    k: int,
    filters: dict[str, Any] | None = None,
    fields: list[str] | None = None,
    *,
    json: bool = False,
    **options,
) -> DataFrame:
    """Filter, search and project: query_id, the fields, cosine, sparse, score, rk.

    ``fields`` defaults to the space's output fields. With ``json`` text fields are VARIANTs.
    """
    names = list(fields or space.output)
    hits = with_fields(hybrid_search(queries, space, k, filters=filters, **options), space, names)
    return with_json(hits, [f for f in names if f != space.id_col]) if json else hits


def without_text(space: Space) -> Space:
    return replace(space, text_col=None, index=None)
