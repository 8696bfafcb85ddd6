"""The best rows of each query within one task, kept while batches of scores pass by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Candidates held before they are cut down to the best ``k`` of each query.
HELD = 1_000_000


class Best:
    """Up to ``k`` best (query number, key, score) of each query; equal scores go by key, ``k`` None keeps all.

    Scores are rounded to six places before they are compared.  Memory is bounded by ``HELD`` and
    k rows for each query.
    """

    def __init__(self, queries: int, k: int | None, key_type: pa.DataType):
        self.k, self.worst = k, np.full(queries, -np.inf)
        self.schema = pa.schema([("q", pa.int32()), ("key", key_type), ("score", pa.float64())])
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, keys: pa.Array, scores: np.ndarray, found: np.ndarray) -> None:
        """A block of scores, one row for each key and one column for each query; ``found`` marks those that count."""
        scores = np.round(scores, 6)
        n = len(scores)
        if self.k is not None:
            if n > self.k:
                ranked = np.partition(np.where(found, scores, -np.inf), n - self.k, axis=0)
                self.worst = np.maximum(self.worst, ranked[n - self.k])
            found = found & (scores >= self.worst)
        row, q = np.nonzero(found)
        self.parts.append(pa.Table.from_arrays([pa.array(q, pa.int32()), keys.take(pa.array(row)), pa.array(scores[row, q])], schema=self.schema))
        self.rows += len(row)
        if self.k is not None and self.rows > HELD:
            self.cut()

    def cut(self) -> None:
        t = pa.concat_tables(self.parts).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
        q = t["q"].to_numpy()
        at = np.arange(len(q))
        nth = at - np.searchsorted(q, q)
        t = t.filter(pa.array(nth < self.k))
        last = nth == self.k - 1
        self.worst[q[last]] = np.maximum(self.worst[q[last]], t["score"].to_numpy()[nth[nth < self.k] == self.k - 1])
        self.parts, self.rows = [t], t.num_rows

    def take(self) -> pa.Table:
        """What is held; only what is left after a cut, if there is a ``k``."""
        if self.k is not None and self.parts:
            self.cut()
        out = pa.concat_tables(self.parts) if self.parts else self.schema.empty_table()
        self.parts, self.rows = [], 0
        return out
