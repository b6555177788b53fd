"""N-gram Jaccard self-join by prefix trees.

Every text is a set of word shingles in one global order, rare shingles first. Sets that
reach the threshold share one of their first few shingles, so these are the first level of
a prefix tree: Spark deals the sets out by them (id, size and place only). Within such a
shard the pairs that length and place still allow become candidates. Candidate sets are then
met in the depth-first order of a trie: sorted, each set continues the path it shares with
the one before it, whose partial overlap is kept, and a subtree is left as soon as what
remains of both sets cannot reach the threshold.

Equal sets are one class from the start. Links are needed up to connected components, so a
first round joins only neighbours in each shard; the second round then skips all pairs whose
classes are already connected, and loses no link between different components. A group of
near copies, however large, therefore costs about one comparison per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import query, stored, table
from metaquarry.llm.components import connected
from metaquarry.llm.shingles import U, fingerprint, runs, shingle_sets, sketch, sketch_distance
from metaquarry.session import ship_package

#: Shingle frequencies are counted over all texts in this many cells by hash (4 MB in all,
#: whatever the input): the global order is (count of the cell, hash).
CELL_BITS, BLOCKS = 20, 16
#: Up to this many ids (16 MB) are broadcast to pick texts; more are joined with a shuffle.
MAX_SHIPPED_IDS = 2_000_000
#: Candidate pairs are written in batches of about this many rows.
BATCH_ROWS = 50_000
STEP = 256
#: In the first round, a set meets so many sets of its shard with the fewest rarer shingles.
HUBS = 2
#: Shards up to this size are searched side by side, longer ones one at a time.
SHORT_SHARD = 64


def _sets(pdf: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, run in runs(pdf["text"].tolist()):
        for k, tokens in enumerate(shingle_sets(run, width)):
            yield first + k, tokens


def _scan(width: int):
    """One row per text (block -1, raw is its sketch), then the task's counts by cell in blocks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for pdf in batches:
            rows = []
            for i, tokens in _sets(pdf, width):
                rows.append((len(tokens), *fingerprint(tokens), sketch(tokens)))
                _count(cells, tokens)
            out = pd.DataFrame(rows, columns=["n", "hi", "lo", "raw"])
            yield out.assign(block=-1, doc_id=pdf["doc_id"].to_numpy())
        for block, part in enumerate(np.split(cells, BLOCKS)):
            if part.any():
                kind = np.min_scalar_type(part.max())
                raw = part.astype(kind).tobytes()
                row = {"block": block, "doc_id": None, "n": kind.itemsize, "hi": 0, "lo": 0, "raw": raw}
                yield pd.DataFrame([row])

    return scan


def _count(cells: np.ndarray, tokens: np.ndarray) -> None:
    at, n = np.unique((tokens >> U(64 - CELL_BITS)).astype(np.int64), return_counts=True)
    cells[at] += n.astype(np.uint32)


def _add_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, size, raw in zip(pdf["block"], pdf["n"], pdf["raw"], strict=True):
            part = np.frombuffer(raw, f"u{size}").astype(np.uint64)
            total[block] = total[block] + part if block in total else part
    for block, part in total.items():
        yield pd.DataFrame({"block": [block], "n": [8], "raw": [part.tobytes()]})


def _total_counts(blocks: DataFrame) -> np.ndarray:
    """Counts of all cells: summed in each task, then by block; BLOCKS rows reach the driver."""
    kind = "block int, n long, raw binary"
    parts = blocks.select("block", "n", "raw").mapInPandas(_add_blocks, kind)
    rows = parts.repartition("block").mapInPandas(_add_blocks, kind).collect()
    out = np.zeros(1 << CELL_BITS, np.uint64)
    size = (1 << CELL_BITS) // BLOCKS
    for row in rows:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["raw"], np.uint64)
    return np.minimum(out, U(2**32 - 1)).astype(np.uint32)


def _ordered(tokens: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    weight = cells[(tokens >> U(64 - CELL_BITS)).astype(np.int64)]
    return tokens[np.argsort(weight, kind="stable")]


def _needed(n, percent: int):
    """Least overlap of a set of n with any set it can be linked with."""
    return -(-n * percent // 100)


def _postings(width: int, percent: int, counts):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, seen = counts.value, set()
        for pdf in batches:
            parts = []
            for _, tokens in _sets(pdf, width):
                n = len(tokens)
                if not n:
                    continue
                key = fingerprint(tokens)
                if key in seen:  # a copy within the task; elsewhere copies meet in the shard
                    continue
                seen.add(key)
                prefix = _ordered(tokens, cells)[: n - _needed(n, percent) + 1]
                parts.append((prefix.astype(np.int64), key, n))
            if parts:
                sizes = [len(p[0]) for p in parts]
                yield pd.DataFrame(
                    {
                        "token": np.concatenate([p[0] for p in parts]),
                        "hi": np.repeat(np.array([p[1][0] for p in parts], np.int64), sizes),
                        "lo": np.repeat(np.array([p[1][1] for p in parts], np.int64), sizes),
                        "n": np.repeat(np.array([p[2] for p in parts], np.int32), sizes),
                        "place": np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                    }
                )

    return post


_POSTING = "token long, hi long, lo long, n int, place int"
_LINK = "ahi long, alo long, bhi long, blo long, an int, bn int"


def _whole_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted postings regrouped so that no shard (token) is cut, copies removed."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        cut = int(np.searchsorted(pdf["token"].to_numpy(), pdf["token"].iat[-1])) if len(pdf) else 0
        if cut:
            yield pd.concat([*rest, pdf.iloc[:cut]]) if rest else pdf.iloc[:cut]
            rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest)


def _columns(pdf: pd.DataFrame, extra: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    c = {k: pdf[k].to_numpy() for k in ("token", "hi", "lo", "n", "place", *extra)}
    if len(pdf) > 1:  # equal sets from several tasks
        fresh = np.ones(len(pdf), bool)
        fresh[1:] = (c["token"][1:] != c["token"][:-1]) | (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
        c = {k: v[fresh] for k, v in c.items()}
    return c


def _possible(c: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Can the sets at rows a and b (sizes na <= nb) be linked through this shared shingle?

    Sets with an overlap of ``need`` share one of their first n - need + 1 shingles.
    """
    na, nb = c["n"][a].astype(np.int64), c["n"][b].astype(np.int64)
    need = -(-percent * (na + nb) // (100 + percent))
    return (need <= na) & (c["place"][a] <= na - need) & (c["place"][b] <= nb - need)


def _link_rows(c: dict, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    # a pair is named the same way in every shard
    swap = (c["hi"][a] > c["hi"][b]) | ((c["hi"][a] == c["hi"][b]) & (c["lo"][a] > c["lo"][b]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame(
        {
            "ahi": c["hi"][a], "alo": c["lo"][a], "bhi": c["hi"][b], "blo": c["lo"][b],
            "an": c["n"][a], "bn": c["n"][b],
        }
    ).drop_duplicates()


def _neighbours(percent: int):
    """Shared postings (role 0), and the pairs of neighbours in each shard (role 1)."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_shards(batches):
            c = _columns(pdf)
            same = c["token"][1:] == c["token"][:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            if not shared.any():
                continue
            yield pd.DataFrame({k: v[shared] for k, v in c.items()}).assign(role=0)
            # the next one by size, and the sets that have the fewest shingles of their own
            order = np.lexsort((c["lo"], c["place"], c["token"]))
            edge = np.flatnonzero(np.concatenate(([True], ~same)))
            shard = np.cumsum(np.concatenate(([True], ~same))) - 1
            last = np.append(edge[1:], len(shared))[shard] - 1
            rows = np.arange(len(shared))
            mates = [np.minimum(rows + 1, last)]
            mates += [order[np.minimum(edge[shard] + k, last)] for k in range(HUBS)]
            a, b = np.concatenate([rows] * len(mates)), np.concatenate(mates)
            a, b = np.minimum(a, b), np.maximum(a, b)
            ok = (a < b) & _possible(c, a, b, percent)
            if ok.any():
                yield _link_rows(c, a[ok], b[ok]).assign(role=1)

    def run(batches):
        names = ["token", "hi", "lo", "n", "place", "ahi", "alo", "bhi", "blo", "an", "bn", "role"]
        for out in meet(batches):
            yield out.reindex(columns=names).astype({k: "Int64" for k in names})

    return run


def _cross_pairs(c: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of one shard each, of different components, that may be linked."""
    edge = np.flatnonzero(np.concatenate(([True], c["token"][1:] != c["token"][:-1])))
    length = np.diff(np.append(edge, len(c["token"])))
    mixed = np.minimum.reduceat(c["component"], edge) != np.maximum.reduceat(c["component"], edge)
    # short shards all at once, by distance; sizes ascend, so who is too far apart stays so
    small = np.repeat(mixed & (length <= SHORT_SHARD), length)
    alive, step = np.flatnonzero(small), 1
    while len(alive):
        alive = alive[alive + step < len(small)]
        near = (c["token"][alive] == c["token"][alive + step]) & (
            100 * c["n"][alive].astype(np.int64) >= percent * c["n"][alive + step].astype(np.int64)
        )
        alive = alive[near]
        b = alive + step
        ok = (c["component"][alive] != c["component"][b]) & _possible(c, alive, b, percent)
        yield alive[ok], b[ok]
        step += 1
    # in a long shard, every row outside of its main component against all rows
    for lo, size in zip(edge[mixed & (length > SHORT_SHARD)], length[mixed & (length > SHORT_SHARD)], strict=True):
        hi = lo + size
        names, counts = np.unique(c["component"][lo:hi], return_counts=True)
        main = names[counts.argmax()]
        others = lo + np.flatnonzero(c["component"][lo:hi] != main)
        rows = np.arange(lo, hi)
        for i in others:
            j = rows[(c["component"][lo:hi] == main) | (rows > i)]
            j = j[c["component"][j] != c["component"][i]]
            a, b = np.minimum(i, j), np.maximum(i, j)
            ok = _possible(c, a, b, percent)
            yield a[ok], b[ok]


def _across(percent: int):
    """Pairs of different components in each shard."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[pd.DataFrame] = []
        size = 0
        for pdf in _whole_shards(batches):
            c = _columns(pdf, ("component",))
            for a, b in _cross_pairs(c, percent):
                if len(a):
                    ready.append(_link_rows(c, a, b))
                    size += len(a)
                if size >= BATCH_ROWS:
                    yield pd.concat(ready).drop_duplicates()
                    ready, size = [], 0
        if ready:
            yield pd.concat(ready).drop_duplicates()

    return meet


def _members(width: int, counts):
    """The ordered sets of texts, as (hi, lo, set)."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = counts.value
        for pdf in batches:
            rows = []
            for _, tokens in _sets(pdf, width):
                rows.append((*fingerprint(tokens), _ordered(tokens, cells).tobytes()))
            yield pd.DataFrame(rows, columns=["hi", "lo", "members"])

    return fetch


class _Trie:
    """Sets met in depth-first order against one anchor set.

    ``overlaps[i]`` is the overlap of the anchor with the first i shingles on the current
    path; a set that shares d of them starts from ``overlaps[d]``.
    """

    def __init__(self, anchor: np.ndarray):
        self.anchor, self.size = np.sort(anchor), len(anchor)
        self.path = np.zeros(0, U)
        self.overlaps = np.zeros(1, np.int64)

    def linked(self, members: np.ndarray, percent: int) -> bool:
        n = len(members)
        need = -(-percent * (self.size + n) // (100 + percent))
        known = min(len(self.path), n)
        differs = np.flatnonzero(self.path[:known] != members[:known])
        depth = int(differs[0]) if len(differs) else known
        parts = [self.overlaps[: depth + 1]]
        have = int(self.overlaps[depth])
        while depth < n and have + min(n - depth, self.size - have) >= need:
            piece = members[depth : depth + STEP]
            at = np.minimum(np.searchsorted(self.anchor, piece), self.size - 1)
            parts.append(have + np.cumsum(self.anchor[at] == piece))
            have, depth = int(parts[-1][-1]), depth + len(piece)
        self.path, self.overlaps = members[:depth], np.concatenate(parts)
        return depth == n and have >= need


def _trie_join(percent: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trie = None, None
        for pdf in batches:
            found = []
            for ahi, alo, salt, bhi, blo, role, raw in pdf.itertuples(index=False):
                members = np.frombuffer(raw, U)
                if role == 0:
                    key, trie = (ahi, alo, salt), _Trie(members)
                elif key == (ahi, alo, salt) and trie.linked(members, percent):
                    found.append((ahi, alo, bhi, blo))
            yield pd.DataFrame(found, columns=["ahi", "alo", "bhi", "blo"], dtype="int64")

    return join


class JaccardJoin:
    """The join's steps over one table of texts; ``components`` runs them all."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        ship_package(docs.sparkSession)
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def _by(self, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*order)

    def scan(self) -> None:
        # ids travel as text: exact in pandas, null or large
        seen = self.docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
            _scan(self.width), "block int, doc_id string, n long, hi long, lo long, raw binary"
        )
        self.seen = stored(seen.withColumn("doc_id", F.col("doc_id").cast("long")), "sets")
        self.rows = self.seen.filter("block = -1").select("doc_id", "n", "hi", "lo")
        counts = _total_counts(self.seen.filter("block >= 0"))
        self.counts = self.spark.sparkContext.broadcast(counts)
        # one document stands for each class of equal sets
        self.classes = stored(
            self.seen.filter("block = -1 and n > 0 and doc_id is not null")
            .groupBy("hi", "lo")
            .agg(F.min("doc_id").alias("first"), F.min("raw").alias("sketch")),
            "classes",
        )

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        posted = self.docs.filter("doc_id is not null").select("text").mapInPandas(
            _postings(self.width, self.percent, self.counts), _POSTING
        )
        met = self._by(posted, ["token"], ["token", "n", "hi", "lo"]).mapInPandas(
            _neighbours(self.percent), f"{_POSTING}, {_LINK}, role int"
        )
        met = stored(met, "shards")
        names = [x.split()[0] for x in _LINK.split(", ")]
        shards = met.filter("role = 0").select("token", "hi", "lo", "n", "place")
        return shards, met.filter("role = 1").select(*names).distinct()

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches do not rule a link out."""
        percent = self.percent

        @F.pandas_udf("boolean")
        def near(an: pd.Series, bn: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            both = an + bn
            most = both - 2 * -(-percent * both // (100 + percent))
            return most >= [sketch_distance(*z) for z in zip(x, y, strict=True)]

        for end in "ab":
            of = self.classes.select(
                F.col("hi").alias(f"{end}hi"), F.col("lo").alias(f"{end}lo"), F.col("sketch").alias(f"{end}s")
            )
            pairs = pairs.join(of, [f"{end}hi", f"{end}lo"])
        return pairs.filter(near("an", "bn", "as", "bs")).select("ahi", "alo", "bhi", "blo")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets reach the threshold, as (a, b) of their first documents."""
        pairs = stored(self.close(pairs), "close")
        both = [F.struct(F.col(f"{x}hi").alias("hi"), F.col(f"{x}lo").alias("lo")) for x in "ab"]
        ends = pairs.select(F.explode(F.array(*both)).alias("end")).select("end.hi", "end.lo").distinct()
        first = ends.join(self.classes, ["hi", "lo"]).select(F.col("first").alias("doc_id")).distinct()
        first = stored(first, "ends")
        few = first.count() <= MAX_SHIPPED_IDS
        texts = self.docs.join(F.broadcast(first) if few else first, "doc_id", "left_semi")
        sets = texts.select("text").mapInPandas(_members(self.width, self.counts), "hi long, lo long, members binary")
        sets = stored(sets.dropDuplicates(["hi", "lo"]), "members")
        # hot anchors are salted; the anchor's own row comes first in each salt
        salted = pairs.select("ahi", "alo", "bhi", "blo", F.pmod("blo", F.lit(16)).cast("int").alias("salt"))
        anchors = salted.select("ahi", "alo", "salt").distinct().join(
            sets.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), "members"), ["ahi", "alo"]
        )
        partners = salted.join(
            sets.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), "members"), ["bhi", "blo"]
        )
        names = ["ahi", "alo", "salt", "bhi", "blo", "role", "members"]
        rows = anchors.withColumns({"bhi": F.lit(0), "blo": F.lit(0), "role": F.lit(0)}).select(*names).unionByName(
            partners.withColumn("role", F.lit(1)).select(*names)
        )
        found = self._by(rows, ["ahi", "alo", "salt"], ["ahi", "alo", "salt", "role", "members"]).mapInPandas(
            _trie_join(self.percent), "ahi long, alo long, bhi long, blo long"
        )
        a = self.classes.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("first").alias("a"))
        b = self.classes.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), F.col("first").alias("b"))
        return found.join(a, ["ahi", "alo"]).join(b, ["bhi", "blo"]).select("a", "b")

    def components(self) -> DataFrame:
        self.scan()
        shards, near = self.candidates()
        links = stored(self.linked(near), "links")
        joined = connected(links, "near").withColumnRenamed("node", "first")
        named = stored(
            self.classes.join(joined, "first", "left").select(
                "hi", "lo", F.coalesce("component", "first").alias("component")
            ),
            "named",
        )
        rest = self._by(
            shards.join(named, ["hi", "lo"]).select("token", "hi", "lo", "n", "place", "component"),
            ["token"],
            ["token", "n", "hi", "lo"],
        ).mapInPandas(_across(self.percent), _LINK)
        pair = ["ahi", "alo", "bhi", "blo"]
        far = stored(rest.distinct().join(near.select(*pair), pair, "left_anti"), "far")
        links = links.unionByName(self.linked(far)) if far.limit(1).count() else links
        # the same document id in several rows is one document
        own = (
            self.rows.filter("n > 0 and doc_id is not null")
            .join(self.classes, ["hi", "lo"])
            .filter("doc_id <> first")
            .select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
        )
        return connected(links.unionByName(own).filter("a <> b"), "all")


def jaccard_components(
    docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Documents are linked when their sets of ``width``-word shingles have a Jaccard index of
    ``percent`` / 100 or more; component_id is the smallest id reachable by links. Texts
    without words, null ones included, have an empty set and are linked with nothing.
    Repeated rows each come back; rows with the same id are one document. A null id takes
    no part and has a null component. Other columns are ignored. An empty table gives an
    empty result. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    join = JaccardJoin(docs, id_col, text_col, width, percent)
    found = join.components()
    return join.rows.join(found, join.rows["doc_id"] == found["node"], "left").select(
        F.col("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, Jaccard 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 85)
