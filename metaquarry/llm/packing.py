"""Mixture-controlled packing into fixed-length sequences, by deficit round-robin.

Every source is a queue: its documents' tokens on one line, in hash order. The output is one
stream of tokens, cut into windows. In each window a queue may give its share of the window
plus the deficit it carries from the windows before; what is left goes to the largest
deficits. Deficits are carried over chunks of windows in one short pass, and inside a chunk
in one task each, so chunks run side by side. All tokens are packed: queues run dry together.
The stream is cut every ``length`` tokens; its tail is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import query, stored, table
from metaquarry.llm.prefix_sums import lay_out
from metaquarry.session import ship_package

LENGTH = 2048
#: Sequences of a window, in which the mixture holds.
WINDOW_SEQUENCES = 32
#: The largest sources have a queue each; all smaller ones share the last queue.
MAX_QUEUES = 4_096
#: Rows of the table of chunks that the driver computes, at most (chunks x queues).
MAX_CHUNK_ROWS = 65_536
END_OF_TEXT = 1
#: Rows that a task handles together.
PART_ROWS = 256


class Encoder:
    """Token ids of texts as bytes, from a file of byte-level BPE ranks.

    Equal to the JSON form of the same vocabulary, with the ids of its added tokens where their
    names stand in a text, and several times as fast on texts with many rare words.
    """

    #: The vocabulary's added tokens. Fixed value.
    ADDED = {"<|endoftext|>": 50256}

    #: Texts are cut into pre-tokens by this pattern. Fixed value of the vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.ADDED)
        self.kind = np.dtype("<u2" if max(*ranks.values(), *self.ADDED.values()) < 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if any(name in text for name in self.ADDED):
                ids = self.encoding.encode(text, allowed_special="all")
            else:
                ids = self.encoding.encode_ordinary(text)
            yield np.array([*ids, END_OF_TEXT], self.kind).tobytes()


def _encode(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, row = Encoder(path), TaskContext.get().partitionId() << 40
        for pdf in batches:
            for i in range(0, len(pdf), PART_ROWS):
                part = pdf.iloc[i : i + PART_ROWS]
                ids = list(encoder.encode([t if isinstance(t, str) else "" for t in part["text"]]))
                digests = [
                    hashlib.md5(f"{d}".encode()).hexdigest()[:16] + f"{zlib.crc32(x):08x}"
                    for d, x in zip(part["doc_id"], ids, strict=True)
                ]
                yield pd.DataFrame(
                    {
                        "row": np.arange(row, row + len(part)),
                        "doc_id": part["doc_id"].array,
                        "source": part["source"].array,
                        "digest": digests,
                        "n": [len(x) // encoder.kind.itemsize for x in ids],
                        "width": encoder.kind.itemsize,
                        "ids": ids,
                    }
                )
                row += len(part)

    return encode


def round_robin(totals: np.ndarray, window: int, count: int, last: int) -> np.ndarray:
    """Tokens of each queue in each of ``count`` windows, as an array (count, queues).

    ``totals`` holds the queues' tokens; windows have ``window`` tokens, the last one
    ``last``. Deficits are kept in exact integers, in units of 1 / sum(totals) tokens.
    """
    whole, left = int(totals.sum()), totals.astype(np.int64).copy()
    deficit = np.zeros(len(totals), object)
    out = np.zeros((count, len(totals)), np.int64)
    share = np.array([int(t) for t in totals], object)
    for k in range(count - 1):
        deficit += share * window
        give = np.array([max(0, d // whole) for d in deficit], np.int64)
        give = np.minimum(give, left)
        over = window - int(give.sum())
        order = np.argsort(np.array([float(d) for d in deficit - give.astype(object) * whole]), kind="stable")
        while over:  # one token each to the largest deficits, or back from the smallest
            for q in order[::-1] if over > 0 else order:
                if over > 0 and left[q] > give[q]:
                    give[q], over = give[q] + 1, over - 1
                elif over < 0 and give[q] > 0:
                    give[q], over = give[q] - 1, over + 1
                if not over:
                    break
        deficit -= give.astype(object) * whole
        left -= give
        out[k] = give
    out[count - 1] = left
    assert int(left.sum()) == last
    return out


def _windows(window: int, chunk_windows: int):
    """The runs of one chunk: (queue, first token on its line, length, place in the stream)."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("queue")
        totals = pdf["tokens"].to_numpy()
        whole = int(totals.sum())
        count = -(-whole // window)
        dealt = round_robin(totals, window, count, whole - (count - 1) * window)
        first = pdf["before"].to_numpy() + np.cumsum(dealt, 0) - dealt
        flat = dealt.ravel()
        place = int(pdf["chunk"].iat[0]) * chunk_windows * window + np.cumsum(flat) - flat
        queue = np.tile(pdf["queue"].to_numpy(), count)
        out = pd.DataFrame({"queue": queue, "first": first.ravel(), "length": flat, "place": place})
        return out[out["length"] > 0]

    return deal


def deal_windows(spark: SparkSession, totals: list[int], window: int) -> DataFrame:
    """(queue, first, length, place): every queue's run in every window."""
    sizes = np.array(totals, np.int64)
    whole = int(sizes.sum())
    windows = -(-whole // window)
    chunks = max(1, min(1_024, MAX_CHUNK_ROWS // max(1, len(totals)), windows))
    chunk_windows = max(1, -(-windows // chunks))
    chunks = -(-windows // chunk_windows)
    span = chunk_windows * window
    dealt = round_robin(sizes, span, chunks, whole - (chunks - 1) * span)
    before = np.cumsum(dealt, 0) - dealt
    rows = [
        (c, q, int(dealt[c, q]), int(before[c, q]))
        for c in range(chunks)
        for q in range(len(totals))
        if dealt[c, q]
    ]
    table_ = spark.createDataFrame(rows, "chunk long, queue int, tokens long, before long")
    return table_.groupBy("chunk").applyInPandas(
        _windows(window, chunk_windows), "queue int, first long, length long, place long"
    )


def _digest_pieces(with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    names += ["ids"] * with_ids

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), PART_ROWS):
                yield pd.DataFrame(rows(pdf.iloc[i : i + PART_ROWS]), columns=names)

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        columns = ["doc_id", "source", "n", "width", "ids", "pieces"]
        for doc_id, source, n, width, raw, pieces in pdf[columns].itertuples(index=False):
            ids = np.frombuffer(raw, f"<u{width}")
            for p in sorted(pieces, key=lambda p: p["start"]):
                part = ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()
                row = (doc_id, p["start"], p["length"], zlib.crc32(part), n, p["sequence_id"], p["offset"], source)
                yield (*row, part) if with_ids else row

    return digest


def pack(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    tokenizer: str,
    length: int = LENGTH,
    window_sequences: int = WINDOW_SEQUENCES,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids) per piece.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, on request. Null and empty texts
    are the end id alone; texts of any length are encoded whole. Null sources form one queue,
    null ids are kept, repeated rows are packed each. Other columns are ignored, whatever their
    names. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    ship_package(spark)
    encoded = stored(
        docs.select(
            F.col(id_col).cast("string").alias("doc_id"),  # exact in pandas, null or large
            F.col(text_col).alias("text"),
            F.col(source_col).cast("string").alias("source"),
        ).mapInPandas(
            _encode(tokenizer),
            "row long, doc_id string, source string, digest string, n long, width int, ids binary",
        ),
        "ids",
    )
    # queues by size; a number per source, the smallest sources share the last
    sums = encoded.groupBy("source").agg(F.sum("n").alias("tokens"))
    ranked = Window.orderBy(F.col("tokens").desc(), F.col("source").asc_nulls_last())
    queues = stored(
        sums.select(
            F.struct("source").alias("line"),
            "tokens",
            F.least(F.row_number().over(ranked) - 1, F.lit(MAX_QUEUES - 1)).alias("queue"),
        ),
        "queues",
    )
    totals = [r["t"] for r in queues.groupBy("queue").agg(F.sum("tokens").alias("t")).orderBy("queue").collect()]
    window = length * window_sequences
    runs = stored(deal_windows(spark, totals, window), "runs") if totals else None
    if runs is None:
        runs = spark.createDataFrame([], "queue int, first long, length long, place long")
    placed = (
        encoded.select("row", "doc_id", F.struct("source").alias("line"), "digest", "n")
        .join(queues.select("line", "queue"), "line")
        .select("row", "doc_id", "digest", "n", F.col("queue").cast("string").alias("source"), "queue")
    )
    placed = lay_out(placed, "n", encoded.count()).select(
        "row", "queue", "start", (F.col("start") + F.col("n")).alias("stop")
    )
    # intervals of one line meet in cells of about a run's length
    whole = max(1, sum(totals))
    widths = str([max(256, -(-window * t // whole)) for t in totals])
    cell_of = F.element_at(F.from_json(F.lit(widths), "array<bigint>"), F.col("queue") + 1) if totals else F.lit(1)

    def in_cells(df: DataFrame, low: str, high: str) -> DataFrame:
        first, last = F.floor(F.col(low) / cell_of), F.floor((F.col(high) - 1) / cell_of)
        return df.withColumn("cell", F.explode(F.sequence(first, last)))

    runs = runs.withColumn("end", F.col("first") + F.col("length"))
    low, high = F.greatest("start", "first"), F.least("stop", "end")
    met = (
        in_cells(placed, "start", "stop")
        .join(in_cells(runs, "first", "end"), ["queue", "cell"])
        .withColumns({"low": low, "high": high})
        # each overlap once, in the cell where it begins
        .filter((F.col("low") < F.col("high")) & (F.floor(F.col("low") / cell_of) == F.col("cell")))
    )
    # the stream's full sequences, then its tail at powers of two
    full = whole // length if totals else 0
    cuts, at = [], full * length
    for bit in reversed(range(length.bit_length())):
        if totals and (whole - full * length) >> bit & 1:
            cuts.append((at, at + (1 << bit)))
            at += 1 << bit
    a = F.col("place") + F.col("low") - F.col("first")
    spans = met.select("row", "start", "low", a.alias("a"), (a + F.col("high") - F.col("low")).alias("b"))
    sequence_of = F.floor(F.col("at") / length)
    begin = sequence_of * length
    end = begin + length
    for i, (c0, c1) in enumerate(cuts):
        inside = (F.col("at") >= c0) & (F.col("at") < c1)
        sequence_of, begin, end = (
            F.when(inside, value).otherwise(other)
            for value, other in ((F.lit(full + i), sequence_of), (F.lit(c0), begin), (F.lit(c1), end))
        )
    firsts = F.array_distinct(
        F.filter(
            F.concat(
                F.array("a"),
                F.transform(
                    F.sequence(F.floor(F.col("a") / length), F.floor((F.col("b") - 1) / length)), lambda k: k * length
                ),
                F.array(*[F.lit(c).cast("long") for c, _ in cuts]).cast("array<bigint>"),
            ),
            lambda x: (x >= F.col("a")) & (x < F.col("b")),
        )
    )
    pieces = (
        spans.withColumn("at", F.explode(firsts))
        .withColumns({"sequence_id": sequence_of.cast("long"), "begin": begin, "end": end})
        .select(
            "row",
            F.struct(
                (F.col("low") - F.col("start") + F.col("at") - F.col("a")).alias("start"),
                (F.least("b", "end") - F.col("at")).cast("long").alias("length"),
                "sequence_id",
                (F.col("at") - F.col("begin")).cast("long").alias("offset"),
            ).alias("piece"),
        )
        .groupBy("row")
        .agg(F.collect_list("piece").alias("pieces"))
    )
    found = encoded.join(pieces, "row").mapInPandas(
        _digest_pieces(with_ids),
        "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, source string" + ", ids binary" * with_ids,
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_mixture_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens: one row per piece."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs, "doc_id", "text", "source", tokenizer_path(), with_ids=False)
