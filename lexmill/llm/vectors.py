"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc


def matrix(batch, key: str, vec: str, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows as doubles) of the rows that take part: id and vector not null, all components finite. Shorter vectors
    are filled up with zeros to the longest, or to width."""
    col = batch.column(vec)
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    out = np.zeros((len(lens), max(width, int(lens.max(initial=0)))))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(len(lens)), lens), place] = flat
    ok = col.is_valid().to_numpy(zero_copy_only=False) & batch.column(key).is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(1)
    ids = pc.fill_null(batch.column(key), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[ok], out[ok]


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def best_of_each(col: np.ndarray, score: np.ndarray, k: int, ids: np.ndarray | None = None) -> np.ndarray:
    """Places of the k highest scores of each col, best first, ties to the smaller id."""
    order = np.arange(len(col)) if ids is None else np.argsort(ids, kind="stable")
    order = order[np.argsort(-score[order], kind="stable")]
    order = order[np.argsort(col[order], kind="stable")]
    c = col[order]
    first = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
    place = np.arange(len(c))
    return order[place - np.maximum.accumulate(np.where(first, place, 0)) < k]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, col: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((col, score, ids))
        self.size += len(col)
        if self.size > 1 << 20:
            kept = self.all()
            self.held, self.size = [kept], 0  # what is added since

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        col, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        at = best_of_each(col, score, self.k, ids)
        return col[at], score[at], ids[at]
