"""BM25 as joins and aggregations over a postings table.

Terms are counted inside the document's row, so postings are never shuffled. A search keeps
only postings of terms some query asks for, weights them and sums them where their document
is read, in numpy blocks of documents x queries that are cut to the best k inside the task:
no (query, document) pair becomes a row, only k rows per query and task are shuffled, and a
term found in most documents costs one posting per document, however many queries ask for it.

That needs the query terms in every task, so it is done only when their number is within a
measured bound; otherwise postings and query terms meet in a join whose frequent terms are
sliced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.functions.text import token_count, tokens
from metaquarry.functions.words import COUNTED, count_listed, unpacked, word_chars
from metaquarry.operators.blocks import RunningTopK
from metaquarry.operators.topk import SMALL_ROWS, maybe_broadcast, top_k
from metaquarry.schemas import BM25_B, BM25_K1
from metaquarry.session import cut_lineage, ship_package, spread, store

SPARSE_DIGITS = 4
TERM_PARTS = 256
# Join a term's postings in slices of about this many rows when queries are not broadcast.
SLICE_ROWS = 1_000_000
# One numpy block: postings gathered per step, and documents x queries scored at once.
STEP_POSTINGS, BLOCK_CELLS = 100_000, 2_000_000
SHARED_TERMS = 64
# Up to this many terms of a vocabulary are looked up inside the row, before words are counted.
LISTED_TERMS = 20_000


def _term_part() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int")


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # id, doc_len, carried attributes, term, tf
    terms: DataFrame  # term, df
    stats: DataFrame  # one row: n_docs, avg_len
    id_col: str
    carried: tuple[str, ...] = ()
    grouped: bool = False  # without LENGTH_TERM postings
    local: bool = False  # a document's postings are neighbours in one partition

    def save(self, path: str, slices: int = 16) -> None:
        """Postings in directories by term hash, sorted by term, so a search reads only
        the directories (partition pruning) and row groups (min/max) of its own terms.
        A term's postings are written by up to ``slices`` tasks."""
        (
            self.postings.withColumn("term_part", _term_part())
            # a frequent term's postings are spread over many files
            .withColumn("slice", F.pmod(F.xxhash64(self.id_col), F.lit(slices)))
            .repartition("term_part", "slice")
            .sortWithinPartitions("term_part", "term")
            .drop("slice")
            .write.partitionBy("term_part")
            .mode("errorifexists")
            .parquet(f"{path}/postings")
        )
        saved = self.postings.sparkSession.read.parquet(f"{path}/postings")
        _document_frequencies(saved).write.parquet(f"{path}/terms")
        stats = self.stats if self.grouped else _statistics(saved)
        stats.write.parquet(f"{path}/stats")

    def pruned(self, vocabulary: DataFrame) -> "Bm25Index":
        """A saved index reduced to the directories that can hold these terms."""
        if "term_part" not in self.postings.columns:
            return self
        # at most TERM_PARTS values
        parts = [r[0] for r in vocabulary.select(_term_part().alias("p")).distinct().collect()]
        return replace(self, postings=self.postings.where(F.col("term_part").isin(parts)))

    @staticmethod
    def load(spark, path: str, id_col: str, carried: tuple[str, ...] = ()) -> "Bm25Index":
        return Bm25Index(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/terms"),
            spark.read.parquet(f"{path}/stats"),
            id_col,
            carried,
        )


# A term no text has; one posting of it per document carries the document's length.
LENGTH_TERM = ""


def _document_frequencies(postings: DataFrame) -> DataFrame:
    # count(tf) keeps the postings subplan the same as the scoring one: its exchange is reused
    return postings.groupBy("term").agg(F.count("tf").alias("df"))


def _statistics(postings: DataFrame) -> DataFrame:
    # no filter here: it would be pushed down and make this another subplan
    own = F.col("term") == LENGTH_TERM
    n_docs, total = F.sum(F.when(own, F.col("tf"))), F.sum(F.when(own, F.col("doc_len")))
    return postings.agg(n_docs.alias("n_docs"), (total / n_docs).alias("avg_len"))


def tokenize(df: DataFrame, id_col: str, text_col: str, han_pairs: bool = False) -> DataFrame:
    """One row per token."""
    return df.select(id_col, F.explode(tokens(F.col(text_col), han_pairs)).alias("term"))


def bm25_index(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    carried: tuple[str, ...] = (),
    vocabulary: DataFrame | None = None,
    small_vocabulary: bool = False,
    han_pairs: bool = False,
    listed: list[str] | None = None,
) -> Bm25Index:
    """Count postings inside each row; ``id_col`` names a row. With a ``vocabulary`` only its
    terms are kept; where it is known to be ``listed``, other words are dropped uncounted.

    Every document adds one posting of LENGTH_TERM, which carries its length. Frequencies
    are counted in a second pass over the texts, which moves counts only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(docs.select(id_col, *carried, text_col))
    if listed is not None and not han_pairs:
        # the counts of listed words are far smaller than the texts, which are read once for them
        counted = rows.select(id_col, *carried, _listed_counts(docs.sparkSession, text, listed).alias("_c"))
        found = counted.select(id_col, *carried, "_c.doc_len", F.col("_c.found").alias("_found"))
        found = store(found, "counts")
        met = found.select("doc_len", F.explode("_found.term").alias("term"))
        own = F.sum(F.when(F.col("term") == LENGTH_TERM, F.col("doc_len")))
        terms = cut_lineage(met.groupBy("term").agg(F.count(F.lit(1)).alias("df"), own.alias("_n")))
        sums = F.max(F.when(F.col("term") == LENGTH_TERM, F.struct("df", "_n"))).alias("_s")
        stats = terms.agg(sums).select(
            F.coalesce("_s.df", F.lit(0).cast("long")).alias("n_docs"), (F.col("_s._n") / F.col("_s.df")).alias("avg_len")
        )
        postings = found.select(id_col, *carried, "doc_len", F.explode("_found").alias("_p")).select(
            id_col, *carried, "doc_len", "_p.term", "_p.tf"
        )
        return Bm25Index(postings, terms.select("term", "df"), stats, id_col, carried, local=True)
    rows = rows.withColumn("_all", tokens(text, han_pairs))
    kept = F.col("_all") if listed is None else F.filter("_all", lambda word: word.isin(listed))
    # lengths alone need no list of words
    length = F.size("_all") if han_pairs else token_count(text)
    sizes = rows.select(length.cast("long").alias("doc_len"))
    stats = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    counted = rows.select(id_col, *carried, F.size("_all").alias("doc_len"), F.sort_array(kept).alias("_words"))
    postings = counted.select(
        id_col, *carried, "doc_len", F.explode(_counts(F.col("_words"))).alias("_p")
    ).select(id_col, *carried, "doc_len", "_p.term", "_p.tf")
    if vocabulary is not None:
        length_term = docs.sparkSession.range(1).select(F.lit(LENGTH_TERM).alias("term"))
        wanted = vocabulary.unionByName(length_term)
        postings = postings.join(maybe_broadcast(wanted, small_vocabulary), "term", "left_semi")
    # without a broadcast vocabulary its join moves the postings
    local = vocabulary is None or small_vocabulary
    return Bm25Index(postings, _document_frequencies(postings), stats, id_col, carried, local=local)


def _listed_counts(spark, text: Column, listed: list[str]) -> Column:
    """The number of a text's words and its array<struct<term, tf>> of listed ones, in their
    order, the length term first."""
    chars, terms = word_chars(spark), [LENGTH_TERM, *listed]

    @F.arrow_udf(COUNTED)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = unpacked(chars)
        for texts in batches:
            yield count_listed(texts, known, terms)

    return counts(F.lower(text))


def _counts(words: Column) -> Column:
    """Sorted words as array<struct<term, tf>>, the length term first: runs of equal words."""

    def runs(w: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))
        )
        found = F.transform(
            F.array(starts),
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(w, at).alias("term"),
                    (F.coalesce(F.get(s, k + 1), F.size(w)) - at).cast("long").alias("tf"),
                ),
            ),
        )
        return F.when(F.size(w) > 0, F.element_at(found, 1)).otherwise(
            F.array().cast("array<struct<term:string,tf:bigint>>")
        )

    length = F.struct(F.lit(LENGTH_TERM).alias("term"), F.lit(1).cast("long").alias("tf"))
    return F.concat(F.array(length), runs(words))


def query_terms(queries: DataFrame, query_id: str, query_text: str, han_pairs=False) -> DataFrame:
    words = F.array_distinct(tokens(F.coalesce(F.col(query_text), F.lit("")), han_pairs))
    return queries.select(query_id, F.explode(words).alias("term"))


def _weighted(index: Bm25Index, terms: DataFrame, small: bool, where: Column | None, k1=BM25_K1, b=BM25_B):
    """Postings of the asked terms with their score contribution ``w``."""
    stats = index.stats.select(F.struct("n_docs", "avg_len")).scalar()
    asked = index.terms.join(maybe_broadcast(terms, small), "term", "left_semi")
    idf = F.log(1 + (stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("term", "df", idf.alias("idf"))
    postings = index.postings if where is None else index.postings.where(where)
    norm = 1 - b + b * F.col("doc_len") / stats["avg_len"]
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return postings.join(maybe_broadcast(asked, small), "term").select(
        index.id_col, *index.carried, "term", "df", w.alias("w")
    )


def _joined_scores(weighted, index, qterms, query_id, allowed, parent) -> DataFrame:
    """All (query, document) scores by a shuffled join; no side is known to be small.

    A frequent term is sliced by document, so its postings meet its queries in many tasks.
    """
    slices = F.ceil(F.col("df") / F.lit(SLICE_ROWS)).cast("int")
    asked = qterms.join(index.terms.select("term", slices.alias("_n")), "term").select(
        query_id, "term", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s")
    )
    own = F.pmod(F.xxhash64(index.id_col), slices).cast("int")
    pairs = weighted.withColumn("_s", own).join(asked, ["term", "_s"])
    if allowed is not None:
        pairs = pairs.join(allowed.select(query_id, parent), [query_id, parent], "left_semi")
    return pairs.groupBy(query_id, index.id_col).agg(
        F.round(F.sum("w"), SPARSE_DIGITS).alias("sparse")
    )


def _block_scores(weighted, index, qterms: pd.DataFrame, query_id, schema, allowed, parent, k):
    """Best k per query and task, with the query terms shipped to every task."""
    spark = weighted.sparkSession
    q_ids = np.asarray(sorted(set(qterms.iloc[:, 0].tolist())))
    names = sorted(set(qterms["term"]))
    term_no = {term: i for i, term in enumerate(names)}
    # queries of term i are asks[starts[i]:starts[i + 1]]
    codes = qterms["term"].map(term_no).to_numpy()
    order = np.argsort(codes, kind="stable")
    asks = np.searchsorted(q_ids, np.asarray(qterms.iloc[:, 0].tolist()))[order]
    starts = np.searchsorted(codes[order], np.arange(len(names) + 1))
    # terms many queries ask for are scored by a matrix product, the others pair by pair
    fans = np.diff(starts)
    shared = np.argsort(-fans, kind="stable")[:SHARED_TERMS]
    shared = shared[fans[shared] >= max(4, len(q_ids) // 16)]
    shared_no = np.full(len(names), -1)
    shared_no[shared] = np.arange(len(shared))
    wants = np.zeros((len(shared), len(q_ids)))
    for i, term in enumerate(shared):
        wants[i, asks[starts[term] : starts[term + 1]]] = 1.0
    numbered = spark.createDataFrame(
        pd.DataFrame({"term": names, "_t": range(len(names))}), "term string, _t int"
    )
    rows = weighted.join(F.broadcast(numbered), "term")
    mask = None
    if allowed is None:
        rows = rows.select(index.id_col, F.lit(0).alias("_p"), "_t", "w")
    else:
        parents = sorted(set(allowed[parent]))
        kind = index.postings.schema[parent].dataType.simpleString()
        numbered = spark.createDataFrame(
            pd.DataFrame({parent: parents, "_p": range(len(parents))}), f"`{parent}` {kind}, _p int"
        )
        rows = rows.join(F.broadcast(numbered), parent).select(index.id_col, "_p", "_t", "w")
        mask = np.zeros((len(parents), len(q_ids)), dtype=bool)
        at = {p: i for i, p in enumerate(parents)}
        known = allowed[allowed[query_id].isin(q_ids.tolist())]
        mask[
            [at[p] for p in known[parent]],
            np.searchsorted(q_ids, np.asarray(known[query_id].tolist())),
        ] = True
    shipped = spark.sparkContext.broadcast((q_ids, asks, starts, mask, shared_no, wants))
    id_col = index.id_col

    def score(rows: pd.DataFrame, best: RunningTopK) -> None:
        q_ids, asks, starts, mask, shared_no, wants = shipped.value
        # rows of a document are together: a new id starts a new document
        names = rows[id_col].to_numpy()
        starts_doc = np.ones(len(names), dtype=bool)
        starts_doc[1:] = names[1:] != names[:-1]
        first, doc = np.flatnonzero(starts_doc), np.cumsum(starts_doc) - 1
        ids = np.asarray(names[first].tolist())
        t, w = rows["_t"].to_numpy(), rows["w"].to_numpy()
        parent_no = rows["_p"].to_numpy()[first]
        width = max(1, BLOCK_CELLS // len(q_ids))
        for low in range(0, len(ids), width):
            n = min(width, len(ids) - low)
            inside = (doc >= low) & (doc < low + n)
            many = np.flatnonzero(inside & (shared_no[t] >= 0))
            mine = np.flatnonzero(inside & (shared_no[t] < 0))
            fan = starts[t[mine] + 1] - starts[t[mine]]
            rep = np.repeat(mine, fan)
            # position of every (posting, asking query) in ``asks``
            offset = np.arange(len(rep)) - np.repeat(np.cumsum(fan) - fan, fan)
            q = asks[starts[t[rep]] + offset]
            cell = (doc[rep] - low) * len(q_ids) + q
            block = np.bincount(cell, weights=w[rep], minlength=n * len(q_ids))
            block = block.astype(np.float64, copy=False).reshape(n, len(q_ids))
            if len(many):
                weights = np.zeros((n, len(wants)))
                weights[doc[many] - low, shared_no[t[many]]] = w[many]
                block += weights @ wants
            hit = block > 0
            if mask is not None:
                hit &= mask[parent_no[low : low + n]]
            block[~hit] = -np.inf
            best.add(block.T, ids[low : low + n])

    def scan(batches):
        q_ids = shipped.value[0]
        best = RunningTopK(len(q_ids), k, SPARSE_DIGITS)
        held, size = [], 0
        for pdf in chain(batches, [None]):
            if pdf is not None and not pdf.empty:
                held.append(pdf)
                size += len(pdf)
            if held and (pdf is None or size > STEP_POSTINGS):
                rows = pd.concat(held, ignore_index=True)
                # postings come sorted by document; the last one may go on in the next batch
                last = rows[id_col].iloc[-1] if pdf is not None else None
                open_rows = rows[id_col] == last if pdf is not None else None
                held, size = [], 0
                if open_rows is not None:
                    held, size = [rows[open_rows]], int(open_rows.sum())
                    rows = rows[~open_rows]
                if not rows.empty:
                    score(rows, best)
        out = best.frame(q_ids, query_id, id_col, "sparse")
        if out is not None:
            yield out

    if not index.local:
        rows = rows.repartition(id_col).sortWithinPartitions(id_col)
    return rows.mapInPandas(scan, schema)


def bm25_search(
    queries: DataFrame,
    source: DataFrame | Bm25Index,
    k: int,
    *,
    query_id: str = "query_id",
    query_text: str = "query_text",
    id_col: str = "doc_id",
    text_col: str = "text",
    carried: tuple[str, ...] = (),
    where: Column | None = None,
    allowed: DataFrame | None = None,
    parent: str | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Top k documents per query: query_id, id, sparse, rk.

    ``source`` is a prebuilt index, or documents that are counted for the query
    vocabulary alone. Document frequencies and lengths always cover the whole collection;
    ``where`` (over ``carried`` columns) and ``allowed`` (query_id, parent) only limit
    which documents score.
    """
    ship_package(queries.sparkSession)
    qterms = query_terms(queries, query_id, query_text)
    asked = _bounded(qterms, small_rows)
    # rows without a parent are no parent's rows
    limits = None if allowed is None else allowed.where(F.col(parent).isNotNull()).select(query_id, parent).distinct()
    limited = None if limits is None else _bounded(limits, small_rows)
    small = asked is not None and (limits is None or limited is not None)
    vocabulary = qterms.select("term").distinct()
    rows = source.postings if isinstance(source, Bm25Index) else source
    id_col = source.id_col if isinstance(source, Bm25Index) else id_col
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id_col, rows.schema[id_col].dataType),
            T.StructField("sparse", T.DoubleType()),
        ]
    )
    if small and (asked.empty or (limited is not None and limited.empty)):
        return queries.sparkSession.createDataFrame([], schema).withColumn("rk", F.lit(1))
    if isinstance(source, Bm25Index):
        index = source
    else:
        if parent is not None and parent not in carried:
            carried = (*carried, parent)
        listed = sorted(set(asked["term"])) if small else None
        if listed is not None and len(listed) > LISTED_TERMS:
            listed = None
        index = bm25_index(source, id_col, text_col, carried, vocabulary, small, listed=listed)
    if small:
        index = index.pruned(vocabulary)
    if limited is not None:
        known = limited[parent].dropna().unique().tolist()
        if len(known) <= LISTED_TERMS:
            # other parents' rows are dropped where counts are read, before they are joined
            own = F.col(parent).isin(known)
            where = own if where is None else where & own
    weighted = _weighted(index, vocabulary, small, where)
    if small:
        scores = _block_scores(weighted, index, asked, query_id, schema, limited, parent, k)
    else:
        scores = _joined_scores(weighted, index, qterms, query_id, limits, parent)
    return top_k(scores, query_id, "sparse", k, index.id_col)


def _bounded(df: DataFrame, rows: int) -> pd.DataFrame | None:
    """The rows of ``df`` if there are at most ``rows``; reads no more than one further."""
    head = df.limit(rows + 1).toPandas()
    return head if len(head) <= rows else None


def group_index(
    docs: DataFrame,
    group_col: str,
    text_col: str,
    vocabulary: DataFrame | None = None,
    small_vocabulary: bool = False,
) -> Bm25Index:
    """Index groups of documents as if each were one long text.

    Token counts are summed, texts are never joined together, and counting is combined
    before the shuffle, so a group may be of any size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = spread(docs.select(group_col, text_col))
    lengths = docs.groupBy(group_col).agg(F.sum(token_count(text)).alias("doc_len"))
    listed = _listed(vocabulary) if vocabulary is not None and small_vocabulary else None
    words = tokens(text) if listed is None else F.filter(tokens(text), lambda word: word.isin(listed))
    rows = docs.select(group_col, F.explode(words).alias("term"))
    if vocabulary is not None and listed is None:
        rows = rows.join(maybe_broadcast(vocabulary, small_vocabulary), "term", "left_semi")
    counts = rows.groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    # both are read twice; counts of groups are far smaller than the texts
    counts, lengths = cut_lineage(counts), cut_lineage(lengths)
    postings = counts.join(lengths, group_col)
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    return Bm25Index(postings, _document_frequencies(counts), stats, group_col, grouped=True)


def _listed(vocabulary: DataFrame) -> list[str] | None:
    """The terms, if they are few enough to be looked up inside a row."""
    head = vocabulary.limit(LISTED_TERMS + 1).collect()
    return sorted(r["term"] for r in head) if len(head) <= LISTED_TERMS else None
