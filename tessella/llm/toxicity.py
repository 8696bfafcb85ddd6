"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't: words and word beginnings that stand in toxic documents
far more often than chance allows label the tokens of the training texts.  The field has two
states, per-token features (the word, its first four and five letters) and transitions; it
learns by the gradient of the conditional likelihood over windows of tokens.  Scoring runs
forward-backward over the whole text.  A token without a weighted feature only has the bias, so
a run of such tokens is a power of one matrix; that makes the exact recursion cheap.  Far from
weighted tokens the marginal settles; what the marginals of all tokens have above that gives the
document's score, and those that pass one half are its spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, fold, labelled_sample, logistic, map_text

HELD_OUT = (5, 0)
#: Labelled documents of each class to learn from.
PER_CLASS = 3000
#: Words of a clean document for each window that it lends to training; three windows at least.
CLEAN_WORDS = 100
CHANCE, RATIO, WINDOW, STEPS = 1e-5, 15, 6, 60
#: Tokens from a weighted one after which marginals have settled.
SETTLE = 64
WORD = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start:int,end:int,marginal:double>>"


def token_features(word: str) -> tuple[str, ...]:
    return (word, "4" + word[:4], "5" + word[:5]) if len(word) > 5 else (word, "4" + word[:4]) if len(word) > 4 else (word,)


def seeds(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features of toxic documents that chance does not explain.

    A feature counts once for each document, and once for each word before it: copies of one
    toxic text say no more than the text.
    """
    n = Counter(y for _, y in docs)
    df = {0: Counter(), 1: Counter()}
    for words, y in docs:
        df[y].update({f for w in set(words) for f in token_features(w)})
    share = n[1] / max(n[0] + n[1], 1)

    def unlikely(a: int, b: int) -> bool:
        rare = a * math.log(share + 1e-9) + b * math.log(a + b + 1) <= math.log(CHANCE)
        return rare and a * max(n[0], 1) >= RATIO * (b + 0.5) * n[1]

    picked = {f for f, a in df[1].items() if unlikely(a, df[0][f])}
    before: dict[str, set[str]] = {f: set() for f in picked}
    for words, y in docs:
        if y:
            for last, w in zip(["", *words], words, strict=False):
                for f in token_features(w):
                    if f in picked:
                        before[f].add(last)
    return {f for f in picked if unlikely(min(df[1][f], len(before[f])), df[0][f])}


@dataclass
class Field:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -4.0]))

    def __post_init__(self):
        self.cache = TwoGenerations(200_000)
        self._powers: np.ndarray | None = None

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "moves": self.moves, "head": self.head}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def emission(self, word: str) -> float:
        """Score of the toxic state over the other; 0 where no feature has a weight."""
        return sum(self.weights.get(f, 0.0) for f in token_features(word.lower()))

    @property
    def powers(self) -> np.ndarray:
        """Normed powers, up to ``SETTLE``, of the matrix of a token without features."""
        if self._powers is None:
            m, p = np.exp(self.moves) * np.exp([0.0, self.bias]), [np.eye(2)]
            for _ in range(SETTLE):
                p.append(p[-1] @ m / (p[-1] @ m).sum())
            self._powers = np.array(p)
        return self._powers

    def run(self, n: int) -> np.ndarray:
        return self.powers[min(n, SETTLE)]

    def settled(self) -> float:
        """The marginal far from any weighted token."""
        a, b = self.powers[-1][0], self.powers[-1][:, 0]
        return float(a[1] * b[1] / (a @ b))

    def between(self, before: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets from 0, marginals) of a run's tokens near its ends; ``before`` is the state at its first token."""
        t = np.arange(size) if size <= 2 * SETTLE else np.append(np.arange(SETTLE), np.arange(size - SETTLE, size))
        a, b = before @ self.powers[np.minimum(t, SETTLE)], self.powers[np.minimum(size - 1 - t, SETTLE)] @ after
        return t, a[:, 1] * b[:, 1] / (a * b).sum(1)

    def marginals(self, at: list[int], e: list[float], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, P(toxic)) of the tokens ``at`` with emissions ``e``, and of those near them; ``n`` in all."""
        move = np.exp(self.moves)
        out, fwd, last = [], np.ones(2), -1
        ahead = []
        for p, x in zip(at, e, strict=True):
            gap = p - last - 1
            a = fwd @ self.run(gap) if last >= 0 else (np.array([1.0, math.exp(self.bias)]) @ self.run(gap - 1) if gap else np.ones(2))
            if p:
                a = a @ move
            a = a * np.array([1.0, math.exp(min(self.bias + x, 50))])
            fwd = a / a.sum()
            ahead.append(fwd)
            last = p
        plain = np.array([1.0, math.exp(self.bias)])
        back, nxt, w = np.ones(2), n, None
        for k in range(len(at) - 1, -1, -1):
            gap = nxt - at[k] - 1
            b = back if w is None else move @ (w * back)
            if gap:
                t, m = self.between((ahead[k] @ move) * plain, b, gap)
                out.append((at[k] + 1 + t, m))
            b = self.run(gap) @ b
            back, nxt = b / b.sum(), at[k]
            w = np.array([1.0, math.exp(min(self.bias + e[k], 50))])
            m = ahead[k] * back
            out.append((np.array([at[k]]), np.array([m[1] / m.sum()])))
        if at[0]:
            t, m = self.between(plain, move @ (w * back), at[0])
            out.append((t, m))
        return np.concatenate([p for p, _ in out[::-1]]), np.concatenate([m for _, m in out[::-1]])

    def document(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and marginals of the tokens with weighted features and of those near them."""
        cache = self.cache
        for w in cache.missing(set(words)):
            cache.young[w] = self.emission(w)
        e = list(map(cache.young.__getitem__, words))
        if not any(e):
            return np.empty(0, int), np.empty(0)
        at = [i for i, x in enumerate(e) if x]
        return self.marginals(at, [e[i] for i in at], len(words))

    def features(self, marginals: np.ndarray) -> np.ndarray:
        """Of a document: the highest marginal, and how many toxic tokens are expected above the settled level."""
        return np.array([marginals.max(initial=0.0), math.log1p(np.maximum(marginals - self.settled(), 0).sum()), 1.0])

    def score(self, marginals: np.ndarray) -> float:
        z = float(self.head @ self.features(marginals))
        return 1 / (1 + math.exp(-max(min(z, 500), -500)))


def fit(texts: list[tuple[str, int]], sizes: dict[int, int]) -> Field:
    """Learn the field from (text, toxic) of sampled documents.

    Without labels of both classes nothing is known: no token has a weight, and every document
    gets the same score, 0.5 without any label, else near the class that is known.
    """
    docs = [([w.lower() for w in WORD.findall(t)], y) for t, y in texts]
    f = Field()
    if len({y for _, y in docs}) < 2:
        f.head = np.array([0.0, 0.0, {0: -4.0, 1: 4.0}.get(docs[0][1], 0.0) if docs else 0.0])
        return f
    good = seeds(docs)
    toxic = lambda w: any(x in good for x in token_features(w))
    rng, rows = np.random.default_rng(0), []
    for words, y in docs:
        if y:
            spots = [i for i, w in enumerate(words) if toxic(w)]
        else:
            spots = rng.integers(0, len(words), max(3, len(words) // CLEAN_WORDS)).tolist() if words else []
        for i in spots:
            part = words[max(i - WINDOW, 0) : i + WINDOW + 1]
            rows.append((part, [int(y and toxic(w)) for w in part]))
    # a feature without any token labelled toxic has nothing to say for the toxic state
    seen = Counter(x for part, labels in rows for w, y in zip(part, labels, strict=True) if y for x in token_features(w))
    names = sorted(x for x, c in seen.items() if c >= 3)
    index = {x: k for k, x in enumerate(names)}
    size = 2 * WINDOW + 1
    ids, gold = np.full((len(rows), size, 3), len(names)), np.zeros((len(rows), size), int)
    mask = np.zeros((len(rows), size))
    for r, (part, labels) in enumerate(rows):
        for t, w in enumerate(part):
            for k, x in enumerate(token_features(w)):
                ids[r, t, k] = index.get(x, len(names))
        gold[r, : len(part)], mask[r, : len(part)] = labels, 1
    theta, moves, bias = np.zeros(len(names) + 1), np.zeros((2, 2)), -2.0
    g_theta, g_moves, g_bias = np.full(len(names) + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6
    both = mask[:, 1:] * mask[:, :-1]
    for _ in range(STEPS):
        emit = np.stack([np.zeros_like(mask), theta[ids].sum(2) + bias], 2) * mask[..., None]
        single, pair = window_marginals(emit, moves, mask)
        miss = (single - gold) * mask
        d_theta = np.bincount(ids.ravel(), np.repeat(miss.ravel(), 3), len(names) + 1) / len(rows) + 1e-4 * theta
        d_theta[-1] = 0
        hit = np.zeros((2, 2))
        np.add.at(hit, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), both.ravel())
        d_moves, d_bias = ((pair * both[..., None, None]).sum((0, 1)) - hit) / len(rows) + 1e-3 * moves, miss.sum() / len(rows)
        g_theta, g_moves, g_bias = g_theta + d_theta**2, g_moves + d_moves**2, g_bias + d_bias**2
        theta -= 0.5 * d_theta / np.sqrt(g_theta)
        moves -= 0.2 * d_moves / np.sqrt(g_moves)
        bias -= 0.2 * d_bias / math.sqrt(g_bias)
    f = Field({x: float(theta[k]) for x, k in index.items() if abs(theta[k]) >= 0.5}, float(bias), moves)
    made = [(f.features(f.document(words)[1]), y) for words, y in docs]
    x, y = np.array([a[:-1] for a, _ in made]), np.array([b for _, b in made])
    f.head = logistic(x, y.astype(float), np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()))
    return f


def window_marginals(emit: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic-state marginals and pair marginals of padded windows by forward-backward."""
    rows, size, _ = emit.shape
    fwd, back = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0]
    for t in range(1, size):
        step = np.logaddexp(fwd[:, t - 1, :1] + moves[0], fwd[:, t - 1, 1:] + moves[1]) + emit[:, t]
        fwd[:, t] = np.where(mask[:, t, None] > 0, step, fwd[:, t - 1])
    for t in range(size - 2, -1, -1):
        v = emit[:, t + 1] + back[:, t + 1]
        step = np.logaddexp(v[:, :1] + moves[:, 0], v[:, 1:] + moves[:, 1])
        back[:, t] = np.where(mask[:, t + 1, None] > 0, step, back[:, t + 1])
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None]
    single = np.exp(np.minimum(fwd[..., 1] + back[..., 1] - z, 0))
    pair = np.exp(
        np.minimum(fwd[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - z[..., None, None], 0)
    )
    return single, pair


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field learned from about ``PER_CLASS`` labelled documents of each class.

    Rows without an id or a label and held-out ids play no part; null texts count as empty;
    repeated ids lend each of their rows; several labels of an id count as their largest.
    """
    picked, sizes = labelled_sample(docs, labels, "toxic", HELD_OUT, PER_CLASS, id_col, text_col)
    rows = sorted((r["doc_id"], r["text"] or "", r["y"]) for r in picked.collect())
    return fit([(t, y) for _, t, y in rows], sizes)


def score_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of ``docs``.

    ``spans``: code-point offsets and marginals of the tokens whose marginal is one half or more.
    Null texts score as empty ones.  A null id is never learned from, so it counts as held out.
    Repeated rows each give a row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(_, texts):
        f = sent.value
        f.cache.age()
        scores, spans = [], []
        for t in texts:
            at, m = f.document(WORD.findall(t or ""))
            scores.append(f.score(m))
            hot = dict(zip(at[m >= 0.5].tolist(), m[m >= 0.5].tolist(), strict=True))
            spans.append(
                [{"start": w.start(), "end": w.end(), "marginal": hot[i]} for i, w in enumerate(WORD.finditer(t)) if i in hot] if hot else []
            )
        return {"score": scores, "spans": spans}

    out = map_text(docs, work, f"doc_id long, score double, spans {SPANS}", id_col, text_col)
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(True))
    return out.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )
