"""Plain single-machine versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def crc_mod(doc_id: int, m: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % m


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        t += n - 9 * (n > 9)
    return t % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text: str | None) -> list[tuple[int, int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii_row(text: str | None) -> tuple:
    s = pii(text)
    n = Counter(k for *_, k in s)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
    return (*(n[k] for k in PII), hashlib.sha256(joined.encode()).hexdigest())


def lower(text: str) -> bytes:
    return text.encode().lower()


def shingles(text: str | None, k: int) -> frozenset:
    w = lower(text or "").split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(docs: list[tuple[int, str | None]], k: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        seen = Counter()
        for g in s:
            seen.update(where.get(g, ()))
            where.setdefault(g, []).append(i)
        for j, n in seen.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def unigram(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    toks = {d: [*lower(t or "").split(), None] for d, t in docs}
    c = Counter(w for d, ws in toks.items() if crc_mod(d, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for d, ws in toks.items()
    }
