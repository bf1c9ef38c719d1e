"""The vectors of largest inner product for many queries at once, kept while the vectors go by."""

from __future__ import annotations

import numpy as np

#: Queries and vectors that are compared at once.
QUERIES, VECTORS = 512, 2048
#: More than what rounding to 12 digits can raise a product by.
MARGIN = 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; lengths count as 1e-12 at least."""
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Best:
    """For each query the k best (score rounded to 12 digits, key), ties to the smaller key; a product that is no number comes last.

    All products are made, but only those that reach a query's k-th best are looked at further.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores = np.zeros((len(queries), 0))
        self.keys: np.ndarray | None = None

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < len(keys):
            width = self.scores.shape[1]
            # the first vectors are all kept, so few are taken; there are k of each query thereafter
            stop = at + (VECTORS if width >= self.k else max(2 * self.k, 64))
            self._some(keys[at:stop], np.ascontiguousarray(x[at:stop].T))
            at = stop

    def _some(self, keys: np.ndarray, columns: np.ndarray) -> None:
        if self.keys is None:
            self.keys = np.zeros(self.scores.shape, keys.dtype)
        elif self.scores.shape[1] < self.k:
            self.keys = self.keys.astype(np.promote_types(self.keys.dtype, keys.dtype))
        if self.scores.shape[1] < self.k:
            return self._fill(keys, columns)
        kind = np.promote_types(self.keys.dtype, keys.dtype)
        if kind != self.keys.dtype:
            self.keys = self.keys.astype(kind)
        for a in range(0, len(self.queries), QUERIES):
            products = self._products(a, columns)
            worst = self.scores[a : a + QUERIES, -1]
            found = np.flatnonzero(products >= (worst - MARGIN)[:, None])
            if not len(found):
                continue
            row, column = np.divmod(found, products.shape[1])
            score = np.round(products.reshape(-1)[found], 12)
            mine = keys[column]
            better = (score > worst[row]) | ((score == worst[row]) & (mine < self.keys[a : a + QUERIES, -1][row]))
            if better.any():
                self._merge(a, row[better], score[better], mine[better])
        return None

    def _products(self, a: int, columns: np.ndarray) -> np.ndarray:
        products = self.queries[a : a + QUERIES] @ columns
        np.copyto(products, -np.inf, where=np.isnan(products)) if np.isnan(products.sum()) else None
        return products

    def _fill(self, keys: np.ndarray, columns: np.ndarray) -> None:
        wide = min(self.k, self.scores.shape[1] + len(keys))
        scores, names = np.empty((len(self.queries), wide)), np.empty((len(self.queries), wide), self.keys.dtype)
        rank = np.unique(np.concatenate([self.keys.reshape(-1), keys]))
        for a in range(0, len(self.queries), QUERIES):
            every = np.concatenate([self.scores[a : a + QUERIES], np.round(self._products(a, columns), 12)], 1)
            own = np.concatenate([self.keys[a : a + QUERIES], np.broadcast_to(keys, (len(every), len(keys)))], 1)
            order = np.lexsort((np.searchsorted(rank, own), -every), axis=1)[:, :wide]
            scores[a : a + QUERIES], names[a : a + QUERIES] = np.take_along_axis(every, order, 1), np.take_along_axis(own, order, 1)
        self.scores, self.keys = scores, names

    def _merge(self, a: int, row: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        changed = np.unique(row)
        rows = np.concatenate([row, np.repeat(changed, self.k)])
        scores = np.concatenate([score, self.scores[a + changed].reshape(-1)])
        keys = np.concatenate([key, self.keys[a + changed].reshape(-1)])
        order = np.lexsort((keys, -scores, rows))
        first = np.searchsorted(rows[order], changed)
        take = order[first[:, None] + np.arange(self.k)]
        self.scores[a + changed], self.keys[a + changed] = scores[take], keys[take]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(scores, keys), a row for each query; no number where a product is none."""
        return np.where(np.isneginf(self.scores), np.nan, self.scores), np.zeros(self.scores.shape, np.int64) if self.keys is None else self.keys
