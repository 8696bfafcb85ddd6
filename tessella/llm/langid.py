"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of characters after up to ``ORDER - 1`` forerunners: absolute
discounting, with continuation counts below the longest order.  The models of all languages
share sorted hash arrays, one of grams and one of contexts for each order; a place holds the
log-probability, or the weight that passes to the shorter context, in every language.  The
lowest cross-entropy a character wins.  Training documents that the models have not seen
calibrate how confident a score is, and how high a cross-entropy may be before a text is
rejected as none of the languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_text
from .hashing import SortedHash, U

ORDER = 4
HELD_OUT = (3, 1)
#: Characters to learn a language from, and in all languages together.
PER_LANGUAGE, IN_ALL = 1_500_000, 16_000_000
SPAN = 1 << 18
SPACE = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of the 16-bit code points, those of letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTERS[0]


def characters(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased letters as 16-bit integers with one space for each run of others; any letter?

    Letters beyond 16 bits take the 2048 places that no character has, by their lower bits.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    high = cp > 0xFFFF
    is_letter = letters()[np.where(high, 0xFFFF, cp)]
    if high.any():
        is_letter[high] = [chr(c).isalpha() for c in cp[high]]
    cp = np.where(is_letter, np.where(high, 0xD800 + cp % 2048, cp), SPACE)
    keep = is_letter | np.append(True, is_letter[:-1])[: len(cp)]
    return np.append(cp[keep], SPACE).astype(U), bool(is_letter.any())


def grams(chars: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each character below its forerunners, 16 bits each; spaces stand before the first."""
    a = np.concatenate([np.full(order - 1, SPACE, U), chars])
    key = np.zeros(len(chars), U)
    for j in range(order):
        key = key << U(16) | a[j : j + len(chars)]
    return key


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & U(2 ** (16 * n) - 1) if n < 4 else keys


@dataclass
class Order:
    grams: SortedHash
    logp: np.ndarray
    contexts: SortedHash
    gamma: np.ndarray


class Models:
    def __init__(self, samples: dict[str, list[str]]):
        """``samples``: texts of each language; every fifth only calibrates."""
        self.languages = sorted(samples)
        self.orders: list[Order] = []
        self.scale, self.worst = 1.0, float("inf")
        if not self.languages:
            return
        learn = {g: [t for i, t in enumerate(ts) if i % 5 != 4] or ts for g, ts in samples.items()}
        self.fit({g: np.concatenate([grams(characters(t)[0]) for t in ts]) for g, ts in learn.items()})
        self.calibrate([(g, t) for g, ts in samples.items() for t in ([t for i, t in enumerate(ts) if i % 5 == 4] or ts)])

    def fit(self, seen: dict[str, np.ndarray]) -> None:
        counts = {g: np.unique(k, return_counts=True) for g, k in seen.items()}
        tables = []  # by order from 1: for each language its grams and counts
        for n in range(1, ORDER + 1):
            row = {}
            for g in self.languages:
                if n == ORDER:
                    row[g] = counts[g]
                else:  # distinct forerunners of the gram
                    longer = np.unique(low(counts[g][0], n + 1))
                    row[g] = np.unique(low(longer, n), return_counts=True)
            tables.append(row)
        for n, row in enumerate(tables, 1):
            union = np.unique(np.concatenate([k for k, _ in row.values()]))
            contexts = np.unique(union >> U(16))
            logp, gamma = np.zeros((len(union), len(self.languages))), np.zeros((len(contexts), len(self.languages)))
            lower = self.log_rows(low(union, n - 1), n - 1)
            for j, g in enumerate(self.languages):
                k, c = row[g]
                at, ctx = np.searchsorted(union, k), np.searchsorted(contexts, k >> U(16))
                total = np.bincount(ctx, c, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                gamma[:, j] = np.log(weight)
                own = np.zeros(len(union))
                own[at] = np.maximum(c - d, 0) / total[ctx]
                logp[:, j] = np.log(own + weight[np.searchsorted(contexts, union >> U(16))] * np.exp(lower[:, j]))
            gram, context = SortedHash(union), SortedHash(contexts)
            self.orders.append(Order(gram, logp[gram.order].astype(np.float32), context, gamma[context.order].astype(np.float32)))
            gram.order = context.order = None

    def log_rows(self, keys: np.ndarray, n: int) -> np.ndarray:
        """log P of each gram of order ``n`` in every language; order 0 is uniform."""
        if n == 0:
            return np.full((len(keys), len(self.languages)), -np.log(65536.0), np.float32)
        o = self.orders[n - 1]
        at = o.grams.find(keys)
        out = o.logp[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            ctx = o.contexts.find(keys[miss] >> U(16))
            passed = np.where((ctx >= 0)[:, None], o.gamma[ctx], np.float32(0))
            out[miss] = passed + self.log_rows(low(keys[miss], n - 1), n - 1)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy a character in every language, characters, any letter?) of each text."""
        made = [characters(t) for t in texts]
        sizes = np.array([len(c) for c, _ in made])
        total = np.zeros((len(texts), len(self.languages)))
        keys = np.concatenate([grams(c) for c, _ in made]) if made else np.empty(0, U)
        doc = np.repeat(np.arange(len(texts)), sizes)
        for at in range(0, len(keys), SPAN):
            rows, d = self.log_rows(keys[at : at + SPAN], ORDER), doc[at : at + SPAN]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            total[d[first]] -= np.add.reduceat(rows, first, axis=0, dtype=np.float64)
        return total / sizes[:, None], sizes, np.array([a for _, a in made], bool)

    def calibrate(self, held: list[tuple[str, str]]) -> None:
        """Choose how sharply gaps of cross-entropy turn into confidence, and the rejection bar."""
        held = [x for x in held if characters(x[1])[1]]
        if not held:
            return
        h, n, _ = self.entropy([t for _, t in held])
        right = np.array([self.languages.index(g) for g, _ in held])
        best = []
        for scale in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            p = posterior(h, n, scale)
            best.append((-np.log(np.maximum(p[np.arange(len(right)), right], 1e-12)).mean(), scale))
        self.scale = min(best)[1]
        own = h[np.arange(len(right)), right]
        self.worst = float(np.quantile(own, 0.995) + 3 * own.std())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', confidence, accepted) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h, n, any_letter = self.entropy([t or "" for t in texts])
        p, win = posterior(h, n, self.scale), h.argmin(1)
        names = [self.languages[w] if ok else "und" for w, ok in zip(win, any_letter, strict=True)]
        score = np.where(any_letter, p[np.arange(len(win)), win], 0.0)
        return names, score, any_letter & (h.min(1, initial=np.inf) <= self.worst)


def posterior(h: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    z = -h * (scale * np.minimum(n, 50))[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of every non-null value of ``lang_col`` among the rows to learn from.

    A hash of the id picks each language's rows so that their texts hold about
    ``PER_LANGUAGE`` characters, ``IN_ALL`` in all languages: the bound of what the driver sees.
    The row of the least hash is always picked, so that every language has one.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min(place).alias("least")).collect()}
    most = min(PER_LANGUAGE, IN_ALL // max(len(sizes), 1))
    share = F.lit(0.0)
    for g, r in sizes.items():
        below = max(min(1.0, most / max(r["n"], 1)) * (1 << 20), r["least"] + 1.0)
        share = F.when(F.col("lang") == g, below).otherwise(share)
    picked = rows.where(place < share).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted((r["doc_id"], r["lang"], r["text"]) for r in picked):
        samples.setdefault(r[1], []).append(r[2])
    return Models(samples)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row of ``docs``.

    ``lang_pred`` is 'und', with score 0, where the text is null or has no letter; ``accepted``
    is false there and where the cross-entropy passes the rejection bar.  Equal cross-entropies
    go to the first language in alphabetical order.  A null id is never learned from, so it
    counts as held out.  Repeated rows each give a row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def work(_, texts):
        names, score, accepted = sent.value.predict(texts)
        return {"lang_pred": names, "score": score, "accepted": accepted}

    out = map_text(docs, work, "doc_id long, lang_pred string, score double, accepted boolean", id_col, text_col)
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
