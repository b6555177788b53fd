"""The words of ``functions.text.tokens`` as positions in the bytes of a whole Arrow batch.

A pattern looks at a text character by character and makes an object of every word; here
numpy finds the words of many texts at once, and Arrow looks them up without copying them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from metaquarry.functions.text import TOKEN_GAPS

CODES, ROW_CODES = 0x110000, 4096
#: Texts looked at in one step, and their bytes (of one text at least).
STEP_TEXTS, STEP_BYTES = 1_000, 4 << 20
# Leading bytes of characters of 2, 3 and 4 bytes: smallest, largest, bits that count.
_LEADS = ((0xC0, 0xDF, 0x1F), (0xE0, 0xEF, 0x0F), (0xF0, 0xF7, 0x07))
_KNOWN: list[bytes] = []


def word_chars(spark: SparkSession) -> bytes:
    """A bit for every code point that can be part of a word, found by the pattern of
    ``tokens`` itself, so both agree whatever Unicode version the JVM has."""
    if not _KNOWN:
        # surrogates stand for no character, so a blank takes their place
        chars = [" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(CODES)]
        rows = [(at, "".join(chars[at : at + ROW_CODES])) for at in range(0, CODES, ROW_CODES)]
        found = spark.createDataFrame(rows, "at long, chars string").select(
            "at", F.regexp_replace("chars", TOKEN_GAPS.rstrip("+"), " ").alias("kept")
        )
        kept = "".join(r["kept"] for r in sorted(found.collect()))
        _KNOWN.append(np.packbits(np.frombuffer(kept.encode("utf-32-le"), np.uint32) != ord(" ")).tobytes())
    return _KNOWN[0]


def unpacked(chars: bytes) -> np.ndarray:
    """The same as a bool for every code point."""
    return np.unpackbits(np.frombuffer(chars, np.uint8)).astype(bool)


def _in_word(data: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Whether the character is part of a word, for every byte of UTF-8."""
    # bytes of longer characters are set below
    mask = np.frombuffer(bytearray(data.tobytes().translate(chars[:256].tobytes())), bool)
    high = np.flatnonzero(data >= 0xC0)
    leads = data[high]
    for more, (low, top, bits) in enumerate(_LEADS, 1):
        at = high[(leads >= low) & (leads <= top)]
        code = (data[at] & bits).astype(np.int32)
        for i in range(1, more + 1):
            code = code << 6 | (data[at + i] & 0x3F)
        found = chars[code]
        for i in range(more + 1):
            mask[at + i] = found
    return mask


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def word_steps(texts: pa.Array, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Steps of lower-cased texts without nulls: their first row, their number, and of all
    pieces (words and what lies between) the row in the step, whether it is a word, the text."""
    offsets = _offsets(texts)
    raw = texts.buffers()[2]
    everything = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
        end = min(end, at + STEP_TEXTS, len(texts))
        starts = offsets[at : end + 1] - offsets[at]
        data = everything[offsets[at] : offsets[end]]
        mask = _in_word(data, chars)
        cut = np.ones(len(data) + 1, bool)
        np.not_equal(mask[1:], mask[:-1], out=cut[1 : len(data)])
        cut[starts] = True
        bounds = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
        rows = np.repeat(np.arange(end - at), np.diff(np.searchsorted(bounds, starts.astype(np.int32))))
        yield at, end - at, rows, mask[bounds[:-1]], pieces
        at = end


#: What ``count_listed`` returns for a text.
COUNTED = "struct<doc_len:int,found:array<struct<term:string,tf:bigint>>>"


def count_listed(texts: pa.Array, chars: np.ndarray, terms: list[str]) -> pa.Array:
    """The number of words, and how often each of the ``terms`` is one; only those met are
    returned, in the order of ``terms``. The first term stands for the text and is met once."""
    names = pa.array(terms, pa.string())
    sizes, keys = [np.empty(0, np.int64)], [np.arange(len(texts)) * len(terms)]
    for at, n, rows, is_word, pieces in word_steps(texts, chars):
        sizes.append(np.bincount(rows[is_word], minlength=n))
        code = pc.index_in(pieces, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        met = np.flatnonzero(is_word & (code >= 0))
        keys.append((rows[met] + at) * len(terms) + code[met])
    found, tf = np.unique(np.concatenate(keys), return_counts=True)
    rows, code = np.divmod(found, len(terms))
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(texts)))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(tf, pa.int64())], ["term", "tf"])
    lengths = pa.array(np.concatenate(sizes).astype(np.int32))
    return pa.StructArray.from_arrays([lengths, pa.ListArray.from_arrays(pa.array(ends), pairs)], ["doc_len", "found"])
