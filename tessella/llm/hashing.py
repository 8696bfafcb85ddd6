"""Array hashing of words, shingles and n-grams, and lookup tables of sorted hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of text hashed at a time; one longer text is hashed as a whole.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                up, down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def groups(texts: list[bytes], size: int = CHUNK) -> Iterator[range]:
    """Ranges of texts of about ``size`` bytes in all."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield range(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(texts):
        yield range(lo, len(texts))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text): words of non-white bytes, A-Z lower-cased."""
    if not texts:
        return np.empty(0, U), np.empty(0, np.int64)
    a = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    white = _WHITE[a]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.get(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(a) + 1, U)
        total[0] = 0
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(first, start, "right") - 1


def shingles_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; the whole of a shorter text."""
    out: list[np.ndarray] = []
    factor = [U(pow(_BASE, 3 * j + 5, 2**64)) for j in range(k)]
    for part in groups(texts):
        h, doc = words_of([texts[i] for i in part])
        n = np.bincount(doc, minlength=len(part)) if len(doc) else np.zeros(len(part), int)
        at = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            if len(h) >= k:
                s = h[: len(h) - k + 1] * factor[0]
                for j in range(1, k):
                    s = s + h[j : len(h) - k + 1 + j] * factor[j]
                s = mix(s)
            else:
                s = np.empty(0, U)
            for d in range(len(part)):
                if n[d] >= k:
                    v = np.unique(s[at[d] : at[d] + n[d] - k + 1])
                elif n[d]:
                    w = h[at[d] : at[d] + n[d]]
                    v = mix(np.array([sum((int(x) * int(f) for x, f in zip(w, factor, strict=False)), int(n[d])) % 2**64], U))
                else:
                    v = np.empty(0, U)
                out.append(v)
    return out


class SortedHash:
    """Places of 64-bit keys in a sorted array of their hashes, found through a directory of the top bits.

    ``mix`` is a bijection, so equal hashes are equal keys.  ``order``: for each place, the
    position of its key in the array that the table was built from.
    """

    def __init__(self, keys: np.ndarray):
        h = mix(keys.astype(U))
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        bits = max(1, int(len(keys)).bit_length() - 1)
        self.shift = U(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange(2**bits + 1, dtype=U)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        h = mix(keys)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(live):
                break
            place = at[live]
            same = self.hashes[place] == h[live]
            out[live[same]] = place[same]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out
