"""Exact top-k by inner product with a dual cover-tree search.

Both sides have a cover tree: a node covers its members within its radius; its children's
centres lie farther apart than half of that radius and cover the members within that half.
The search walks pairs of nodes.  For centres q, r with radii a, b no member pair scores above
<q, r> + |q| b + |r| a + a b; a pair of nodes is dropped when that is below the worst kth
score of the query node's members.  Promising pairs go first, which raises those scores early.

Queries come in blocks of bounded size, each broadcast with its tree; every task builds trees
over bounded blocks of its own data, keeps its queries' best scores from block to block, and
hands over k rows for each query.  Scores are integers, computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

QUERY_BLOCK, DATA_BLOCK, LEAF = 20_000, 8192, 48


class CoverTree:
    """Nodes over the rows of ``x``; ``order`` lists the rows so that each node's are one stretch."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.stretch: list[tuple[int, int]] = []
        self.order = np.empty(len(x), np.int64)
        self._at = 0
        if len(x):
            self._grow(x.shape[0])
        self.norm = np.sqrt((x[self.center] ** 2).sum(1)) if len(x) else np.empty(0)
        self.centers = x[self.center] if len(x) else x
        # a thousandth of slack covers the rounding of distances
        self.radii = np.array(self.radius) * (1 + 1e-9) + 1e-3

    def _distance(self, c: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[members] - self.x[c]) ** 2).sum(1))

    def _grow(self, n: int) -> None:
        members = np.arange(n)
        stack = [(-1, 0, members, self._distance(0, members))]
        # depth first, children in order, so that stretches nest
        while stack:
            parent, c, members, d = stack.pop()
            if parent == -2:  # all descendants of node c are placed
                self.stretch[c] = (self.stretch[c][0], self._at)
                continue
            me = len(self.center)
            self.center.append(c)
            self.radius.append(float(d.max()))
            self.children.append([])
            self.stretch.append((self._at, self._at))
            if parent >= 0:
                self.children[parent].append(me)
            stack.append((-2, me, members, d))
            if len(members) <= LEAF or self.radius[me] == 0:
                self._place(members)
                continue
            half, rest, dist = self.radius[me] / 2, members, d
            parts, alone = [], []
            center, own = c, d
            while True:
                near = own <= half
                if near.sum() > 1 or center == c:
                    parts.append((center, rest[near], own[near]))
                else:
                    alone.append(rest[near])
                rest, dist = rest[~near], dist[~near]
                if not len(rest):
                    break
                center = int(rest[dist.argmax()])  # the farthest from the parent's centre
                own = self._distance(center, rest)
            # members that cover no other share buckets of one leaf's size
            flat = np.concatenate(alone) if alone else np.empty(0, np.int64)
            for lo in range(0, len(flat), LEAF):
                some = flat[lo : lo + LEAF]
                parts.append((int(some[0]), some, self._distance(int(some[0]), some)))
            if len(parts) == 1:
                self._place(members)
                continue
            for p in reversed(parts):
                stack.append((me, *p))

    def _place(self, members: np.ndarray) -> None:
        self.order[self._at : self._at + len(members)] = members
        self._at += len(members)


class Best:
    """Each query's best (score, id) pairs so far; equal scores go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.kept: list[dict[int, int]] = [{} for _ in ids]
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, q: int, found: list[tuple[int, int]]) -> None:
        kept, own = self.kept[q], int(self.ids[q])
        for score, i in found:
            if i != own and score > kept.get(i, score - 1):
                kept[i] = score
        if len(kept) >= self.k:
            top = sorted(kept.items(), key=lambda p: (-p[1], p[0]))[: self.k]
            self.kept[q] = dict(top)
            self.worst[q] = top[-1][1]


def search(queries: CoverTree, best: Best, data: CoverTree, ids: list[list[int]]) -> None:
    """Offer to ``best`` all that may belong to a query's best; ``ids``: those of each row of ``data``."""
    if not len(queries.x) or not len(data.x):
        return
    qx, dx = queries.x[queries.order], data.x[data.order]
    exact = len(qx) and float(np.abs(qx).max()) * float(np.abs(dx).max()) * qx.shape[1] < 2**53
    if not exact:
        qx, dx = np.array(qx, dtype=object).astype(int).astype(object), np.array(dx, dtype=object).astype(int).astype(object)

    def bounds(qs: list[int], rs: list[int]) -> np.ndarray:
        a, b = queries.radii[qs][:, None], data.radii[rs][None]
        return queries.centers[qs] @ data.centers[rs].T + queries.norm[qs][:, None] * b + data.norm[rs][None] * a + a * b

    def worst(q: int) -> float:
        lo, hi = queries.stretch[q]
        return best.worst[queries.order[lo:hi]].min()

    stack = [(float(bounds([0], [0])[0, 0]), 0, 0)]
    while stack:
        bound, q, r = stack.pop()
        if bound < worst(q) * (1 - 1e-12 * np.sign(worst(q))) - 1e-6:
            continue
        qs, rs = queries.children[q] or [q], data.children[r] or [r]
        if qs == [q] and rs == [r]:
            (a, b), (c, d) = queries.stretch[q], data.stretch[r]
            scores = qx[a:b] @ dx[c:d].T
            hit = scores >= best.worst[queries.order[a:b]][:, None]
            for i in np.flatnonzero(hit.any(1)):
                js = np.flatnonzero(hit[i])
                row = int(queries.order[a + i])
                best.offer(row, [(int(scores[i, j]), v) for j in js for v in ids[data.order[c + j]]])
            continue
        all_bounds = bounds(qs, rs)
        low = np.array([worst(x) for x in qs])
        at = np.argwhere(all_bounds >= np.where(np.isfinite(low), low - 1e-6 - 1e-12 * np.abs(low), low)[:, None])
        value = all_bounds[at[:, 0], at[:, 1]]
        for n in np.argsort(value, kind="stable"):  # the highest bound ends up on top
            stack.append((float(value[n]), qs[at[n, 0]], rs[at[n, 1]]))


def distinct(vec: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors, and the k + 1 smallest ids of each: with the query's own left out, k remain."""
    flat = np.ascontiguousarray(vec + 0.0).view(np.dtype((np.void, vec.shape[1] * 8)))[:, 0]
    _, first, back = np.unique(flat, return_index=True, return_inverse=True)
    order = np.lexsort((ids, back))
    edge = np.flatnonzero(np.diff(back[order], prepend=-1))
    return vec[first], [sorted(set(x.tolist()))[: k + 1] for x in np.split(ids[order], edge[1:])]


def matrix(rows: list[list[float]], width: int) -> np.ndarray:
    """Rows as floats of whole numbers; shorter ones go on with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(
    vectors: DataFrame, query_ids: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best rows by integer inner product.

    ``query_ids``: SQL condition on ``id`` that picks the queries.  Components count as
    floor(``scale`` * x).  Rows without an id or a vector, and vectors with null or non-finite
    components, take no part; vectors of unequal lengths count as followed by zeros.  A row is
    never a candidate for its own id.  Where rows repeat an id, the pair of ids has the best
    score of their vectors, once.  Fewer candidates than ``k`` give fewer rows.
    """
    spark = prepare(vectors.sparkSession)
    x = F.col(vector_col)
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    rows = (
        vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & good)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"),
        )
    )
    asked = rows.where(query_ids)
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    blocks = -(-n // QUERY_BLOCK)
    parts = []
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        tree = CoverTree(matrix([r["v"] for r in got], width))
        sent = spark.sparkContext.broadcast((tree, np.array([r["id"] for r in got], np.int64)))
        made = rows.mapInArrow(_search_task(sent, width, k), "query_id long, vec_id long, score long")
        parts.append(made if blocks == 1 else cut(made))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_task(sent, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, query_ids = sent.value
        best = Best(query_ids, k)
        held: list[pa.RecordBatch] = []

        def block() -> None:
            if not held:
                return
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            rows = [r for b in held for r in b.column(1).to_pylist()]
            vec, of = distinct(matrix(rows, width), ids, k)
            search(tree, best, CoverTree(vec), of)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= DATA_BLOCK:
                block()
        block()
        out = {(int(q), i): s for q, kept in zip(query_ids, best.kept, strict=True) for i, s in kept.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64()), pa.array(list(out.values()), pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    return run


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
