"""Word shingles of texts as 64-bit hashes, computed with numpy for a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
#: Texts are hashed in runs of about this many bytes, which bounds a task's memory.
RUN_BYTES = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_ODD) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    size = max(1 << (n - 1).bit_length(), 1 << 16)
    if size not in _powers:
        if size > 4 * RUN_BYTES:  # a very long text: not kept
            return tuple(np.cumprod(np.full(n, b, U)) for b in (_BASE, _INVERSE))
        _powers[size] = tuple(np.cumprod(np.full(size, b, U)) for b in (_BASE, _INVERSE))
    return tuple(p[:n] for p in _powers[size])


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word; ``data`` ends with a blank."""
    blank = _BLANK[data]
    word = ~blank
    starts = np.flatnonzero(word & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], word[:-1])))
    up, down = _power_tables(len(data))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[data] * up)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts


_PLACE = mix(np.arange(64, dtype=U), 2) | U(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words has one shingle of all its words, a text without
    words none.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    hashes, starts = _word_hashes(data)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(starts, firsts)  # of each text's first word
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(width, U)))
    total = np.zeros(n, U)
    for i in range(width):
        total += padded[i : n + i] * _PLACE[i]
    total = mix(total, width)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=U)
            out.append(mix(np.array([short], U), 100 + int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about RUN_BYTES, with the index of each run's first text."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(raw) > RUN_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = mix(tokens, 3).sum(dtype=U) + U(len(tokens))
    b = mix(tokens, 4).sum(dtype=U) ^ mix(np.array([len(tokens)], U), 5)[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the counts of a set's hashes in cells, about two for each member.

    Two sets that differ in d members have sketches that differ in d bits at most.
    """
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens, 6) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
