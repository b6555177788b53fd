"""Ranked lexical search with bag deduplication.

Scores depend only on how often a document holds the terms that items ask for, and on its
length. So documents are restricted to the items' vocabulary; documents with the same term
counts and the same length factor form a class, found by a hash of both and kept apart by the
counts themselves. Each class is scored once against every item, and the best classes are
expanded to their members in the order of ids.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import lower_ascii, query, stored, table
from metaquarry.session import ship_package

K = 50
#: Items are searched in blocks of about this many (item, term) pairs, which bounds what the
#: driver holds and ships; each block is a job of its own over all documents.
BLOCK_PAIRS = 200_000
#: Cells (pairs x classes) that a task scores together.
CELLS = 1 << 21
#: Members of a class are gathered over this many parts first.
PARTS = 16
#: Characters between terms: ASCII ones that are neither digits nor letters.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BAG = "terms array<int>, tfs array<int>, n long, docs array<long>, nulls long, copies long"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, term); rows with the same id are one item."""
    words = F.split(F.regexp_replace(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), f"[{BETWEEN}]+", " "), " ")
    pairs = items.select(F.col(id_col).cast("long").alias("item"), F.explode(F.array_distinct(words)).alias("term"))
    return pairs.filter("term <> ''").distinct()


def blocks(pairs: DataFrame, size: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, in blocks of about ``size`` pairs; an item is never split."""
    block, held = [], 0
    for row in pairs.orderBy("item", "term").toLocalIterator():
        if not block or block[-1][0] != row["item"]:
            if held >= size:
                yield block
                block, held = [], 0
            block.append((row["item"], []))
        block[-1][1].append(row["term"].encode())
        held += 1
    if block:
        yield block


def _bags(vocabulary, k: int):
    """Equal bags of a batch as one row: term numbers and counts, length, the first ids."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value.get
        for pdf in batches:
            found: dict[tuple, list] = {}
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                words = text.translate(_TERMS).split() if text is not None else []
                counts = Counter(map(number, words))
                counts.pop(None, None)
                terms = np.array(sorted(counts), np.int32)
                tfs = np.array([counts[t] for t in terms.tolist()], np.int32)
                found.setdefault((terms.tobytes(), tfs.tobytes(), len(words)), []).append(doc)
            rows = []
            for (terms, tfs, n), docs in found.items():
                ids = sorted(int(d) for d in docs if d is not None)
                row = (np.frombuffer(terms, np.int32), np.frombuffer(tfs, np.int32), n, ids[:k])
                rows.append((*row, len(docs) - len(ids), len(docs)))
            yield pd.DataFrame(rows, columns=["terms", "tfs", "n", "docs", "nulls", "copies"])

    return collect


def _classes(bags: DataFrame, m: Column, k: int) -> DataFrame:
    """One row per class: counts and m, with its k smallest ids and its number of null ids."""
    first = F.slice(F.sort_array(F.flatten(F.collect_list("docs"))), 1, k).alias("docs")
    keyed = bags.withColumn("m", m).withColumn("key", F.xxhash64("m", "terms", "tfs"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("docs"), F.lit(PARTS)))
    same = ["key", "m", "terms", "tfs"]
    parts = keyed.groupBy(*same, "part").agg(first, F.sum("nulls").alias("nulls"))
    return parts.groupBy(*same).agg(first, F.sum("nulls").alias("nulls"))


class _Best:
    """The k best classes of every item seen so far, by score and then by first id."""

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, members: list[tuple[list[int], int]]) -> None:
        """``scores`` (items, classes); ``members`` the ids and null ids of each class."""
        for item, at in zip(*np.nonzero(scores >= self.least[:, None]), strict=True):
            ids, nulls = members[at]
            held = self.found[item]
            held.append((-int(scores[item, at]), not len(ids), ids[0] if len(ids) else 0, ids, nulls))
            if len(held) >= 4 * self.k:
                self._cut(item)

    def _cut(self, item: int) -> None:
        held = self.found[item]
        held.sort(key=lambda r: r[:3])
        del held[self.k :]
        if len(held) == self.k:
            self.least[item] = -held[-1][0]

    def rows(self, item: int) -> list[tuple[int | None, int]]:
        """The k best documents."""
        self._cut(item)
        out = [(s, False, d) for s, _, _, ids, _ in self.found[item] for d in ids]
        out += [(s, True, 0) for s, _, _, _, nulls in self.found[item] for _ in range(min(nulls, self.k))]
        return [(None if null else d, -s) for s, null, d in sorted(out)[: self.k]]


def _score(shared, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, flat, starts, weights = shared.value
        best, step = _Best(len(items), k), max(1, CELLS // len(flat))
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                sizes = [len(t) for t in part["terms"]]
                terms, tf = np.concatenate(part["terms"].array), np.concatenate(part["tfs"].array).astype(np.int64)
                m = np.repeat(part["m"].to_numpy(np.int64), sizes)
                cells = np.zeros((len(weights), len(part)), np.int64)
                cells[terms, np.repeat(np.arange(len(part)), sizes)] = weights[terms] * (
                    (1_000_000_000 * tf) // (1_000 * tf + 20 * m)
                )
                members = list(zip(part["docs"], part["nulls"], strict=True))
                best.add(np.add.reduceat(cells[flat], starts, axis=0), members)
        for at, item in enumerate(items):
            found = best.rows(at)
            if found:
                docs, scores = zip(*found, strict=True)
                yield pd.DataFrame(
                    {
                        "item": pd.array([item] * len(docs), "Int64"),
                        "doc": pd.array(docs, "Int64"),
                        "score": scores,
                    }
                )

    return score


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, terms in block for t in terms}))}
    bags = stored(docs.mapInPandas(_bags(sc.broadcast(vocabulary), k), _BAG), "bags")
    whole = bags.filter("n > 0").agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("n")).alias("words"))
    n_docs, n_words = (x or 0 for x in whole.first())
    held = bags.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.collect():  # at most one row per term of the block
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    wide = "decimal(38,0)"
    share = F.expr(f"cast(50 * cast(n as {wide}) * {n_docs} as {wide}) div cast({max(n_words, 1)} as {wide})")
    classes = _classes(bags.filter("size(terms) > 0"), share.cast("long") + 50, k)
    flat = np.array([vocabulary[t] for _, terms in block for t in terms], np.int64)
    starts = np.cumsum([0] + [len(terms) for _, terms in block[:-1]])
    shared = sc.broadcast(([item for item, _ in block], flat, starts, weights))
    found = classes.select("m", "terms", "tfs", "docs", "nulls").mapInPandas(
        _score(shared, k), "item long, doc long, score long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    item_text_col: str,
    k: int = K,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The k best documents of every item: (item, rank, doc, score).

    Whole texts are read; null and empty texts, and texts without terms, score 0 and are not
    returned. Equal scores go by ascending id, null ids last. Every row is a document, so
    repeated rows each count and are each returned. Rows with the same item id are one item
    with the terms of all; items without terms, and items of which no document holds a term
    of weight above 0, have no rows. Ids are integers. Other columns are ignored, whatever
    their names; empty tables give no rows. A term's weight is computed on the driver, once
    per term of a block of items.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # as text, since pandas would turn whole numbers beside nulls into floats
    number = F.col(id_col).cast("long").cast("string")
    docs = docs.select(number.alias("doc"), F.col(text_col).cast("binary").alias("text"))
    out = spark.createDataFrame([], "item long, doc long, score long, rank int")
    pairs = stored(item_terms(items, item_col, item_text_col), "item-terms")
    for block in blocks(pairs, block_pairs):
        out = out.unionByName(_search_block(docs, block, k))
    return out.select("item", "rank", "doc", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN}]+') AS words
  FROM documents),
whole AS (SELECT count(*) AS big_n, sum(len(words)) AS big_l FROM d WHERE len(words) > 0),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN}]+')) AS term
  FROM benchmark),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, big_n),
scored AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN asked USING (term), whole GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""


@query("op13_bag_search", SQL)
def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = search(docs, "doc_id", "text", items, "item_id", "text")
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
