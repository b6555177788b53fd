"""Removal of long repeated passages, found with run-length indexes of the corpus.

A window is a string of ``length`` bytes. Windows are dealt to tasks by their anchor, the
position in them whose hash is the smallest: equal windows have equal anchors, so they meet.
Neighbouring windows with one anchor form a region, which is handled as one string:

1. A first pass counts anchors. Bitmaps of fixed size tell tasks which ones repeat, and which
   stand in different regions.
2. A second pass hands on the regions of repeated anchors; equal regions become one class with
   its number of copies, and only classes that share an anchor with others carry their text.
3. Classes of one anchor go to one block. A block's text is indexed by its run-compressed
   Burrows-Wheeler transform with samples at the ends of runs. Streaming over the text with
   these gives the matching statistics: at each byte, how long a string also starts elsewhere.
   Windows that reach ``length`` are marked, and so are all windows of a class with copies.
4. An anchor with much text is split by longer strings around it until no group is large.

Marks are joined back to the documents, whose marked bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import query, stored, table
from metaquarry.llm.phrases import bitmap, bits_at
from metaquarry.llm.shingles import _power_tables, mix
from metaquarry.session import ship_package

U = np.uint64
LENGTH = 200
#: Bytes that are hashed at an anchor.
ANCHOR = 48
#: Bits of the bitmaps of repeated anchors (16 MB each), whatever the corpus. Fuller bitmaps
#: hand more regions on and never fewer.
BITS = 27
#: Texts are hashed in pieces of about this many bytes, and indexed in blocks of about as many.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 2 << 20
#: Groups with more text are split; a group is at most one window of text in the end.
GROUP_BYTES = 1 << 20
#: Into how many parts the windows of an anchor are split, the more the deeper.
SPLITS = (4, 16, 1 << 30)
#: Regions that a task remembers having handed on.
REMEMBERED = 500_000

SEPARATOR = b"\xff"  # in no UTF-8 text
_BYTES = [mix(np.arange(256, dtype=U), salt) for salt in (21, 22)]


# --- the index of a block -------------------------------------------------------------------


def _words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros behind the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(U)
    out = np.zeros(len(text), U)
    for j in range(8):
        out |= padded[j : len(text) + j] << U(56 - 8 * j)
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling over the ties that are left."""
    n = len(text)
    words = _words_at(text)
    order = np.argsort(words, kind="stable")
    new = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    depth = 8
    while len(tied):
        at = order[tied]
        ahead = at + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.concatenate((new[1:], [True])))]
        depth *= 2
    return order


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and at ``b``, up to the text's end."""
    n = len(words)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        same = differ == 0
        rest = live[~same]
        high = np.frexp((differ[~same] >> U(8)).astype(np.float64))[1] + 8  # bits in use, but for roundings up
        high = np.where(differ[~same] < U(256), 8, high)
        high -= (differ[~same] >> (high - 1).astype(U)) == 0
        out[rest] += (64 - high) // 8
        out[live[same]] += 8
        live = live[same]
    return np.minimum(out, n - np.maximum(a, b))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with samples at the ends of runs.

    ``heads`` and ``lengths`` are the runs; the start of the text counts as a byte of its own,
    256. At the border of two runs ``last`` and ``first`` are the suffixes on both sides and
    ``common`` is what they share. Size grows with the runs, not with the text.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        before = np.where(order == 0, 256, text[order - 1].astype(np.int64))
        border = np.flatnonzero(before[1:] != before[:-1])
        starts = np.concatenate(([0], border + 1))
        self.heads, self.lengths = before[starts], np.diff(np.concatenate((starts, [len(text)])))
        self.first, self.last = order[starts], order[np.concatenate((border, [len(text) - 1]))]
        self.common = _common(_words_at(text), self.last[:-1], self.first[1:])
        self.size = len(text)

    def statistics(self) -> np.ndarray:
        """For each position, the longest string from there on that also starts elsewhere.

        Inside a run a suffix and its neighbour are preceded by the same byte, so going one
        byte on in the text makes their match one shorter; only run ends hold a length.
        """
        none = np.zeros(1, np.int64)
        place = np.arange(self.size)
        out = np.zeros(self.size, np.int64)
        for at, match in (
            (self.first, np.concatenate((none, self.common))),
            (self.last, np.concatenate((self.common, none))),
        ):
            sampled = np.full(self.size, -1)
            sampled[at] = match
            held = np.maximum.accumulate(np.where(sampled >= 0, place, 0))
            out = np.maximum(out, sampled[held] - (place - held))
        return out


# --- anchors and regions --------------------------------------------------------------------


class _Regions:
    """The regions of some texts, all of them at least ``length`` bytes long.

    start, windows: the first window and how many; text: which text; offset: of the anchor
    from the start; group: the anchor's hash; a, b: 128 bits of the region.
    """

    def __init__(self, texts: list[bytes], length: int):
        k = min(ANCHOR, length)
        raw = SEPARATOR.join(texts) + SEPARATOR
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        up, down = _power_tables(n)
        sums = [np.concatenate((np.zeros(1, U), np.cumsum(b[data] * up))) for b in _BYTES]
        hashes = mix((sums[0][k:] - sums[0][:-k]) * down[: n - k + 1], 23)
        low = U((1 << n.bit_length()) - 1)
        best = _window_least((hashes & ~low) | np.arange(len(hashes), dtype=U), length - k + 1)
        sizes = np.array([len(t) for t in texts])
        firsts = np.cumsum(sizes + 1) - sizes - 1
        end = np.repeat(firsts + sizes, sizes + 1)[: len(best)]
        start = np.flatnonzero(np.arange(len(best)) + length <= end)
        anchor = (best[start] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
        self.windows = np.diff(np.concatenate((new, [len(start)])))
        first, anchor = start[new], anchor[new]
        last = first + self.windows - 1 + length
        self.a, self.b = (
            mix((s[last] - s[first]) * down[first] + (last - first).astype(U), 24) for s in sums
        )
        self.text = np.searchsorted(firsts, first, "right") - 1
        self.start, self.offset, self.group = first - firsts[self.text], anchor - first, hashes[anchor]
        self.raw, self.first, self.last = raw, first, last


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    rows = np.concatenate((values, np.full(-n % width, ~U(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(texts: list[bytes], copies: list[int], length: int) -> Iterator[tuple[list[int], list[int], _Regions]]:
    """(text numbers, offsets of the parts, regions) of texts with a window, about PIECE_BYTES each.

    A long text is cut into parts that overlap by a window less one byte, so each window is in
    one part.
    """
    held, room = [], PIECE_BYTES
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + length - 1]
            if held and len(part) > room:
                yield _piece(held, length)
                held, room = [], PIECE_BYTES
            held.append((i, at, part))
            room -= len(part)
    if held:
        yield _piece(held, length)


def _piece(held, length):
    return [h[0] for h in held], [h[1] for h in held], _Regions([h[2] for h in held], length)


def _distinct(pdf: pd.DataFrame) -> tuple[list[bytes], list[bytes], list[int]]:
    """Distinct texts of a batch, their keys and how many rows have each."""
    found = pdf.groupby("key", sort=False)["text"].agg(["first", "size"])
    return found["first"].tolist(), found.index.tolist(), found["size"].tolist()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _count_anchors(length: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, _, copies = _distinct(pdf)
            for numbers, _, r in _pieces(texts, copies, length):
                n = np.array(copies)[np.array(numbers)[r.text]]
                yield pd.DataFrame({"grp": _signed(r.group), "a": _signed(r.a), "copies": n})

    return count


_ROW = "key binary, start long, windows int, grp long, a long, b long, copies long, off int, text binary"


def _hand_on(repeated, contested, length: int):
    """Regions of repeated anchors; of contested ones with the text, once per task and region."""

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again, mixed = (np.frombuffer(b.value, np.uint8) for b in (repeated, contested))
        seen: set[int] = set()
        for pdf in batches:
            texts, keys, copies = _distinct(pdf)
            for numbers, offsets, r in _pieces(texts, copies, length):
                bit = r.group & U(8 * len(again) - 1)
                at = np.flatnonzero(bits_at(again, bit))
                text = np.array(numbers)[r.text[at]]
                strings = np.full(len(at), None, object)
                for i in np.flatnonzero(bits_at(mixed, bit[at])).tolist():
                    a = int(r.a[at[i]])
                    if a not in seen:
                        seen.add(a)
                        strings[i] = r.raw[r.first[at[i]] : r.last[at[i]]]
                yield pd.DataFrame(
                    {
                        "key": [keys[t] for t in text],
                        "start": r.start[at] + np.array(offsets)[r.text[at]],
                        "windows": r.windows[at].astype(np.int32),
                        "grp": _signed(r.group[at]),
                        "a": _signed(r.a[at]),
                        "b": _signed(r.b[at]),
                        "copies": np.array(copies)[text],
                        "off": r.offset[at].astype(np.int32),
                        "text": strings,
                    }
                )
                if len(seen) > REMEMBERED:
                    seen.clear()

    return regions


# --- marks ----------------------------------------------------------------------------------

_MARK = "grp long, a long, b long, lo int, hi int"


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _mark(length: int, block_bytes: int):
    """Marked windows of classes without copies; rows come by group, which is never split."""

    def block(rows: list) -> pd.DataFrame:
        text = np.frombuffer(SEPARATOR.join([r.text for r in rows]) + SEPARATOR, np.uint8)
        long = RunIndex(text).statistics() >= length
        out, at = [], 0
        for r in rows:
            if r.copies == 1:
                for lo, hi in zip(*_runs_of(long[at : at + r.windows]), strict=True):
                    out.append((r.grp, r.a, r.b, lo, hi))
            at += len(r.text) + 1
        return pd.DataFrame(out, columns=["grp", "a", "b", "lo", "hi"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if size > block_bytes and r.grp != rows[-1].grp:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r.text) + 1
        if rows:
            yield block(rows)

    return mark


def _split(length: int, parts: int):
    """Windows of a class by how far their anchor is from their start, in ``parts`` ranges.

    All windows of a range hold the same string around the anchor, longer than the anchor by
    what the range leaves; that string is the new group.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = min(ANCHOR, length)
        edges = np.unique(np.linspace(0, length - k + 1, min(parts, length - k + 1) + 1).astype(int)).tolist()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for low, high in zip(edges[:-1], edges[1:], strict=True):  # bytes before the anchor
                    first, last = max(0, r.off - high + 1), min(r.windows - 1, r.off - low)
                    if first <= last:
                        shared = r.text[r.off - low : r.off + length - high + 1]
                        text = r.text[first : last + length]
                        out.append((r.grp, r.a, r.b, first, r.copies, last - first + 1, r.off - first, text, shared))
            columns = ["grp0", "a0", "b0", "shift", "copies", "windows", "off", "text", "shared"]
            yield pd.DataFrame(out, columns=columns)

    return split


_SPLIT = (
    "grp0 long, a0 long, b0 long, shift int, copies long, windows int, off int, text binary, shared binary"
)
_CLASS = ["grp", "a", "b"]


def _classes(rows: DataFrame) -> DataFrame:
    held = rows.groupBy(*_CLASS).agg(
        F.sum("copies").alias("copies"),
        F.first("windows").alias("windows"),
        F.first("off").alias("off"),
        F.first("text", ignorenulls=True).alias("text"),
    )
    return stored(held, "region-classes")


def marks(classes: DataFrame, length: int, group_bytes: int, block_bytes: int, splits: tuple = SPLITS) -> DataFrame:
    """(grp, a, b, lo, hi): windows from lo to before hi of these classes have a copy."""
    whole = classes.filter("copies > 1").select(*_CLASS, F.lit(0).alias("lo"), F.col("windows").alias("hi"))
    texts = classes.filter("text is not null").select(*_CLASS, "copies", "windows", "off", "text")
    large = texts.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") > group_bytes)
    large = stored(large.select("grp"), "large-groups") if splits else None
    deeper = None
    if splits and large.limit(1).count():
        parted = texts.join(large, "grp").mapInPandas(_split(length, splits[0]), _SPLIT)
        parted = stored(
            parted.withColumn("grp", F.xxhash64("shared", F.lit(splits[0])))
            .withColumn("hash", F.md5("text"))
            .withColumn("a", F.conv(F.substring("hash", 1, 15), 16, 10).cast("long"))
            .withColumn("b", F.conv(F.substring("hash", 16, 15), 16, 10).cast("long"))
            .drop("shared", "hash"),
            "split-groups",
        )
        inner = marks(_classes(parted), length, group_bytes, block_bytes, splits[1:])
        deeper = parted.drop("text").join(inner, _CLASS).select(
            F.col("grp0").alias("grp"), F.col("a0").alias("a"), F.col("b0").alias("b"),
            (F.col("shift") + F.col("lo")).alias("lo"), (F.col("shift") + F.col("hi")).alias("hi"),
        )
        texts = texts.join(large, "grp", "left_anti")
    dealt = texts.repartition("grp").sortWithinPartitions("grp")
    found = whole.unionByName(dealt.mapInPandas(_mark(length, block_bytes), _MARK))
    return found if deeper is None else found.unionByName(deeper)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    starts, ends, kept = [], [], []
    for text, marked in zip(texts, spans, strict=True):
        data = np.frombuffer(text, np.uint8)
        depth = np.zeros(len(data) + 1, np.int64)
        for span in marked if marked is not None else ():
            depth[span["start"]] += 1
            depth[span["end"]] -= 1
        gone = np.cumsum(depth)[:-1] > 0
        lo, hi = _runs_of(gone)
        starts.append(lo)
        ends.append(hi)
        kept.append(data[~gone].tobytes())
    return pd.DataFrame({"starts": starts, "ends": ends, "kept": kept})


def remove_repeats(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    length: int = LENGTH,
    group_bytes: int = GROUP_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each document without the strings of ``length`` bytes that also start anywhere else.

    (doc, n_bytes, starts, ends, kept): the maximal removed byte ranges and what is left, as
    bytes, since a range may end inside a character. Whole texts are read as UTF-8; null texts
    are empty, and texts shorter than ``length`` stay whole. Every row is a document, so
    repeated rows are copies of each other and lose what is long enough; no copy is preferred.
    Matches never cross documents; overlaps within one count. Ids only label rows and may
    repeat or be null. Regions are told apart by 128 bits of hash. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    long = docs.filter(F.octet_length("text") >= length).select("key", "text")
    anchors = long.mapInPandas(_count_anchors(length), "grp long, a long, copies long").groupBy("grp")
    anchors = anchors.agg(F.sum("copies").alias("n"), F.min("a").alias("a"), F.max("a").alias("z")).filter("n > 1")
    anchors = stored(anchors.select("grp", (F.col("a") != F.col("z")).alias("contested")), "anchors")
    bit = F.pmod("grp", F.lit(1 << BITS))
    repeated = sc.broadcast(bitmap(anchors, bit, BITS))
    contested = sc.broadcast(bitmap(anchors.filter("contested"), bit, BITS))
    rows = stored(long.mapInPandas(_hand_on(repeated, contested, length), _ROW), "regions")
    found = marks(_classes(rows), length, group_bytes, block_bytes)
    places = rows.select("key", "start", *_CLASS).distinct().join(found, _CLASS)
    span = F.struct(
        (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") - 1 + length).alias("end")
    )
    spans = places.groupBy("key").agg(F.collect_list(span).alias("spans"))
    cut = F.pandas_udf(_cut, "starts array<long>, ends array<long>, kept binary")
    cut = docs.join(spans, "key", "left").select("doc", "text", cut("text", "spans").alias("cut"))
    return cut.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), "cut.*")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, base + i AS i, md5(substr(part, 2 * i + 1, {2 * LENGTH})) AS hash
  FROM (SELECT r, base, part, unnest(range(0, length(part) // 2 - {LENGTH - 1})) AS i
        FROM (SELECT r, base, substr(h, 2 * base + 1, {2 * (500 + LENGTH - 1)}) AS part
              FROM (SELECT r, h, unnest(range(0, length(h) // 2, 500)) AS base FROM d)))),
marked AS (SELECT r, i FROM w SEMI JOIN (SELECT hash FROM w GROUP BY hash HAVING count(*) > 1) USING (hash)),
numbered AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new
        FROM marked)),
spans AS (SELECT r, min(i) AS lo, max(i) + {LENGTH} AS hi FROM numbered GROUP BY r, span),
gaps AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM spans),
cut AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


@query("op12_run_index", SQL)
def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
