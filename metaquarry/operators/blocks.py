"""Best-k bookkeeping for scores computed in numpy blocks inside a task."""

from __future__ import annotations

import numpy as np
import pandas as pd


# Digits that cosines are rounded to before they are ranked.
DENSE_DIGITS = 6


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Values that sort as the ids do, missing ones last."""
    if ids.dtype != object:
        return ids
    known = ~pd.isna(ids)
    places = np.full(len(ids), len(ids))
    places[known] = np.unique(ids[known], return_inverse=True)[1]
    return places


class RunningTopK:
    """The k best (score, id) per query over any number of score blocks; ties by lower id,
    a missing id last.

    Scores count rounded to ``digits``; only those that can be among the best are rounded, as
    rounding all would be much of the work. Keeps at most a few times k entries per query,
    whatever the number of blocks.
    """

    def __init__(self, queries: int, k: int, digits: int = DENSE_DIGITS):
        self.k, self.digits = k, digits
        self.floor = np.full(queries, -np.inf)  # a score below this cannot be among the best
        self._parts: list[tuple] = []
        self._pending = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is queries x ids; entries of -inf are no hits."""
        slack = 10.0**-self.digits  # more than rounding can add
        keep = scores >= (self.floor - slack)[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(keep) > 4 * self.k * len(self.floor):
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            # the k-th best of rounded scores is the k-th best score, rounded
            np.maximum(self.floor, np.round(kth, self.digits), out=self.floor)
            keep = scores >= (self.floor - slack)[:, None]
        if np.isneginf(self.floor).any():
            keep &= scores > -np.inf
        rows, cols = np.nonzero(keep)
        found = np.round(scores[rows, cols], self.digits)
        best = found >= self.floor[rows]
        self._parts.append((rows[best], ids[cols[best]], found[best]))
        self._pending += int(np.count_nonzero(best))
        if self._pending > 16 * self.k * len(self.floor):
            self._compress()

    def _compress(self) -> None:
        rows, ids, scores = (np.concatenate(x) for x in zip(*self._parts))
        order = np.lexsort((_ordered(ids), -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows, side="left")
        place = np.arange(len(rows)) - first
        kept = place < self.k
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])
        self._parts = [(rows[kept], ids[kept], scores[kept])]
        self._pending = int(kept.sum())

    def frame(self, q_ids: np.ndarray, q_name: str, id_name: str, score_name: str):
        """The result so far, in rank order per query; None if nothing was found."""
        if not self._parts:
            return None
        self._compress()
        rows, ids, scores = self._parts[0]
        return pd.DataFrame({q_name: q_ids[rows], id_name: ids, score_name: scores})
