"""Quality scores by Bradley-Terry ranking of preference pairs.

A pair is a labelled good and a labelled bad document; the model says that the good one wins
with the logistic of the difference of two linear scores of measured features.  All pairs of all
labelled documents count.  The threshold is a quantile of the training documents' scores: a given
one, or the one below which the share of the bad exceeds that of the good by most.  A slope maps
scores to 0..1 so that the threshold falls on ``ACCEPT``.

Nothing is sampled, and the pairs are not formed: between the nodes of a short interval of scores
the logistic is a polynomial to 1e-11, so sums over the documents of each interval, weighted by its
nodes, give the likelihood of all pairs and its gradient.  Features stay in a checkpointed table;
each step is one pass over it, and the driver holds only such sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, labelled, least, map_text, prepare

ACCEPT = 0.7
#: The weights' prior counts as one of so many pairs.
PRIOR = 40_000
#: Labelled documents in a partition of features, and the fewest partitions.
PART_ROWS, PARTS = 100_000, 8
#: Width and nodes of the intervals of scores.
WIDTH, NODES = 0.5, 8
#: Deviations at which a feature is clipped.
CLIP = 8
HELD_OUT = (4, 2)

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: From Chebyshev polynomials at a place to the weights of the nodes ``_AT`` there.
_NODE = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES), 2, 1)[:, None] / NODES

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate(
    [b"#*$%&<>", b"|", b"0123456789", bytes(range(65, 91)), b".,;:!?", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)), bytes(range(32))]
):
    _CLASSES[list(_chars), _k] = 1


def features(text: str | None) -> np.ndarray:
    """Length, character-class shares, word and line repetition of a whole text; zeros for none."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    size, n, m = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES) / size
    pairs = list(zip(words, words[1:], strict=False))
    return np.array(
        [
            np.log1p(len(raw)),
            np.log1p(len(words)),
            sum(map(len, words)) / n,
            *np.sqrt(shares),
            sum(map(eq, words, words[1:])) / n,
            len(set(pairs)) / max(len(pairs), 1),
            len(set(lines)) / m,
            np.log1p(len(raw) / m),
        ]
    )


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -CLIP, CLIP)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    quantile: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        # row by row: a matrix product may round equal rows apart
        return (standard(x, self.mean, self.scale) * self.weights).sum(1)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        return self.score(np.array([features(t) for t in texts]).reshape(len(texts), len(self.mean)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


Blocks = Iterable[tuple[np.ndarray, np.ndarray]]


class Held:
    """Training rows in memory: features ``x`` and labels ``y``."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def each(self, work: Callable[[Blocks], object]) -> list:
        """What ``work`` makes of the blocks (x, y) of each partition, in their order."""
        return [work([(self.x, self.y)])]

    def ranked(self, model: Ranker) -> Callable:
        """The same of (score, bad rows, good rows), by scores that are all different."""
        s, at = np.unique(model.raw(self.x), return_inverse=True)
        n = [np.bincount(at[self.y == c], minlength=len(s)) for c in (0, 1)]
        return lambda work: [work(0, s, *n)]


class Spread:
    """Training rows in a table (x, y) whose partitions and order are fixed."""

    def __init__(self, table: DataFrame):
        self.table = table

    def each(self, work: Callable[[Blocks], object]) -> list:
        return gathered(self.table, lambda _, batches: work(blocks(batches)))

    def ranked(self, model: Ranker) -> Callable:
        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y in blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), pa.array(y)], names=["s", "y"])

        made = self.table.mapInArrow(scores, "s double, y int").groupBy("s")
        table = cut(made.agg(F.sum(1 - F.col("y")).alias("bad"), F.sum("y").alias("good")).sort("s"))

        def each(work: Callable) -> list:
            def run(part: int, batches: Iterator[pa.RecordBatch]):
                cols = [[np.asarray(c) for c in b.columns] for b in batches]
                return work(part, *map(np.concatenate, zip(*cols, strict=True))) if cols else None

            return [r for r in gathered(table, run) if r is not None]

        return each


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy()


def gathered(table: DataFrame, work: Callable) -> list:
    """``work(number, batches)`` of each partition, in the order of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = pickle.dumps(work(part, batches))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.binary())], names=["part", "made"])

    rows = table.mapInArrow(run, "part int, made binary").collect()
    return [pickle.loads(r["made"]) for r in sorted(rows, key=lambda r: r["part"])]


def moments(parts: Iterable[tuple]) -> tuple:
    """(bad rows, good rows, means, squared distances from them), put together from those of parts."""
    n, mean, square = np.zeros(2, np.int64), 0.0, 0.0
    for n2, mean2, square2 in parts:
        if n2.sum():
            share, gap = n2.sum() / (n.sum() + n2.sum()), mean2 - mean
            square = square + square2 + gap**2 * share * n.sum()
            n, mean = n + n2, mean + gap * share
    return n, mean, square


def nodes(rows: Blocks, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict:
    """By class and interval of scores: sums of (1, z) for each node, and of the products of (1, z)."""
    out: dict = {}
    for x, y in rows:
        z = standard(x, mean, scale)
        s = z @ w / WIDTH
        cell = np.floor(s)
        share = np.polynomial.chebyshev.chebvander(2 * (s - cell) - 1, NODES - 1) @ _NODE
        z = np.column_stack([np.ones(len(z)), z])
        order = np.lexsort((cell, y))
        ends = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(y[order]) != 0)) + 1
        for at in np.split(order, ends):
            key, v = (int(y[at[0]]), int(cell[at[0]])), z[at]
            add(out, key, share[at].T @ v, v.T @ v)
    return out


def add(out: dict, key: tuple, *sums: np.ndarray) -> None:
    out[key] = tuple(a + b for a, b in zip(out[key], sums, strict=True)) if key in out else sums


def all_pairs(rows: Held | Spread, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple:
    """Mean loss of all pairs of a good and a bad row with the prior's, its gradient and its curvature.

    The curvature takes each score as the middle of its interval.
    """
    total: dict = {}
    for part in rows.each(lambda b: nodes(b, mean, scale, w)):
        for key, sums in part.items():
            add(total, key, *sums)
    sides = []
    for c in (0, 1):
        keys = sorted(k for k in total if k[0] == c)
        cells = np.array([k[1] for k in keys])
        at = ((cells[:, None] + (_AT + 1) / 2) * WIDTH).ravel()
        sides.append((at, np.concatenate([total[k][0] for k in keys]), (cells + 0.5) * WIDTH, np.array([total[k][1] for k in keys])))
    (low, bad, low_mid, bad2), (high, good, high_mid, good2) = sides
    pairs = good2[:, 0, 0].sum() * bad2[:, 0, 0].sum()
    loss, slope, curve = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for k in range(0, len(high), NODES):  # an interval at a time: few sums are held
        gap = high[k : k + NODES, None] - low
        n, p = good[k : k + NODES], np.exp(-np.logaddexp(0, gap))
        loss += n[:, 0] @ np.logaddexp(0, -gap) @ bad[:, 0]
        slope -= (p @ bad[:, 0]) @ n[:, 1:] - (n[:, 0] @ p) @ bad[:, 1:]
    for mid, g in zip(high_mid, good2, strict=True):
        h = np.exp(-np.logaddexp(0, mid - low_mid) - np.logaddexp(0, low_mid - mid))
        b = np.tensordot(h, bad2, 1)
        cross = np.outer(g[0, 1:], b[0, 1:])
        curve += g[1:, 1:] * b[0, 0] + g[0, 0] * b[1:, 1:] - cross - cross.T
    return loss / pairs + w @ w / (2 * PRIOR), slope / pairs + w / PRIOR, curve / pairs + np.eye(len(w)) / PRIOR


def parted(each: Callable, n: np.ndarray, weight: np.ndarray, quantile: float | None) -> tuple[float, float]:
    """The threshold among ranked scores, and the share of rows below it."""
    ends = each(lambda part, s, bad, good: (part, s[0], bad.sum(), good.sum()))
    before, seen = {}, np.zeros(2, np.int64)
    for part, _, bad, good in ends:
        before[part] = seen
        seen = seen + (bad, good)

    def best(part: int, s: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple:
        """(rank, share below, part, score, next score) of the partition's best place to cut after."""
        bad, good = np.cumsum(bad) + before[part][0], np.cumsum(good) + before[part][1]
        below = (bad * weight[0] + good * weight[1]) / (n @ weight)
        # in whole numbers, so that equal shares are equal; the first of the best
        rank = bad * n[1] - good * n[0] if quantile is None else np.where(below <= quantile, bad + good, 0)
        at = int(np.argmax(rank))
        return int(rank[at]), float(below[at]), part, float(s[at]), float(s[at + 1]) if at + 1 < len(s) else None

    _, share, part, s, after = max(each(best), key=lambda r: (r[0], -r[2]))
    if after is None:
        after = next((first for p, first, *_ in ends if p > part), s)
    return (s + float(after)) / 2, share


def steepness(rows: Held | Spread, model: Ranker, weight: np.ndarray) -> float:
    """The slope of a logistic regression of the labels on the scores beyond the threshold."""

    def at(w: np.ndarray) -> tuple:
        def work(rows: Blocks) -> tuple:
            loss, slope, curve = 0.0, np.zeros(2), np.zeros((2, 2))
            for x, y in rows:
                z = np.column_stack([model.raw(x) - model.threshold, np.ones(len(x))])
                v, m = weight[y], z @ w
                p = np.exp(-np.logaddexp(0, -m))
                loss, slope = loss + v @ np.logaddexp(0, np.where(y == 1, -m, m)), slope + (v * (p - y)) @ z
                curve = curve + (z * (v * p * (1 - p))[:, None]).T @ z
            return loss, slope, curve

        loss, slope, curve = (sum(p) for p in zip(*rows.each(work), strict=True))
        return loss + 0.005 * w @ w, slope + 0.01 * w, curve + 0.01 * np.eye(2)

    return max(abs(float(least(at, np.zeros(2))[0])), 1e-3)


def learn(rows: Held | Spread, sizes: dict[int, int] | None = None, quantile: float | None = None) -> Ranker:
    """Learn from all ``rows``; ``sizes`` are those of the classes, where the rows are not all.

    ``quantile``: the share of all labelled documents, by their classes' sizes, that score below
    the threshold; None takes the one that parts the classes best.
    With labels of one class only, or none, every document gets one score: 1 where only good
    ones are known, 0 where only bad ones are, 0.5 without labels.
    """
    n, mean, square = moments(
        rows.each(lambda b: moments((np.bincount(y, minlength=2), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)) for x, y in b if len(y)))
    )
    if not n.all():
        p = n[1] / n.sum() if n.any() else 0.5
        k = len(mean) if n.any() else len(features(""))
        z = np.log((p + 1e-9) / (1 - p + 1e-9)) - np.log(ACCEPT / (1 - ACCEPT))
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), -z, 1.0)
    scale = np.maximum(np.sqrt(square / n.sum()), 1e-9)
    w = least(lambda w: all_pairs(rows, mean, scale, w), np.zeros(len(mean)))
    weight = np.array([sizes[c] / n[c] for c in (0, 1)]) if sizes else np.ones(2)
    model = Ranker(mean, scale, w, 0.0, 1.0)
    model.threshold, model.quantile = parted(rows.ranked(model), n, weight, quantile)
    model.slope = steepness(rows, model, weight * n.sum() / (weight @ n))
    return model


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], quantile: float | None = None) -> Ranker:
    """``learn`` from features and labels in memory, of classes of the given sizes."""
    return learn(Held(x, y), sizes, quantile)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quantile: float | None = None) -> Ranker:
    """The ranking learned from all labelled documents.

    Rows without an id or a label and held-out ids play no part; null texts count as empty;
    repeated ids lend each of their rows; several labels of an id count as their largest.
    """
    known = labelled(labels, "quality", HELD_OUT)
    parts = max(PARTS, -(-known.count() // PART_ROWS))

    def measured(_, texts: list[str | None]) -> dict:
        x = np.array([features(t) for t in texts])
        return {"x": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[-1], x.ravel())}

    # features, not texts, are dealt out by id
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = map_text(rows.where(fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]), measured, "doc_id long, x array<double>")
    joined = made.repartition(parts, "doc_id").join(known.repartition(parts, "_l"), F.col("doc_id") == F.col("_l"))
    # in one order, so that every run adds up alike
    return learn(Spread(cut(joined.coalesce(parts).sortWithinPartitions("doc_id", "x").select("x", "y"))), None, quantile)


def score_documents(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Null texts score as empty ones.  A null id is never learned from, so it counts as held out.
    Repeated rows each give a row; other columns are ignored.
    """
    out = map_text(
        docs,
        lambda _, texts: {"score": model.texts(texts)},
        "doc_id long, score double",
        id_col,
        text_col,
    )
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``ACCEPT`` or more, with all their columns.

    Null texts score as empty ones.  Rows are judged one by one: repeated rows stay or go
    together; an empty table stays empty.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.texts(texts.to_pylist()), pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) >= ACCEPT)
