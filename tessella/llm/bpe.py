"""BPE encoding and decoding with a contiguous rank array per short word.

Each word is a row of part ids with a row of the ranks of adjacent pairs beside it.
A step scans the rank row for its (leftmost) minimum, writes the merged id at the left
boundary, deletes the right one by closing the gap, and looks up the two neighbouring
ranks anew.  Rows of one length class step together, so a scan is one array operation for
thousands of words.  Words over ``SHORT`` bytes use a heap over a linked list, which
gives the same merges without a scan that grows with the square of the length.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import TwoGenerations, map_text

SHORT = 96
CACHE_WORDS = 400_000
NONE = np.int32(2**31 - 1)
WS = "\t-\r \u0085   -     　"
#: The published pattern of byte-level vocabularies, with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where visible, else the next letter from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in seen}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class RankArrayBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in self.special}
        token_bytes |= {i: t.encode() for t, i in self.special.items()}
        ordered = [token_bytes.get(i, b"") for i in range(max(token_bytes) + 1)]
        self.token_size = np.array([len(t) for t in ordered], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_flat = np.frombuffer(b"".join(ordered), np.uint8)
        self.cut = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spaces = [chr(c) for c in range(0x3001) if regex.match(f"[{WS}]", chr(c))]
        self.cache = TwoGenerations(CACHE_WORDS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the vocabulary merges no such pair."""
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            if len(w) > SHORT:
                out[n] = np.array(self.long_word(w), "<u4").tobytes()
            elif w:
                classes.setdefault((len(w) + 3) // 4 * 4, []).append(n)
        for width, members in classes.items():
            for lo in range(0, len(members), 8192):
                part = members[lo : lo + 8192]
                rows, sizes = self.short_words([words[n] for n in part], width)
                for n, row, size in zip(part, rows, sizes, strict=True):
                    out[n] = row[:size].tobytes()
        return out

    def short_words(self, words: list[bytes], width: int) -> tuple[np.ndarray, list[int]]:
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        size = np.array([len(w) for w in words])
        col = np.arange(width)
        parts = np.where(col < size[:, None], self.byte_id[flat], np.int32(-1))
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        done, live = np.empty((len(words), width), "<u4"), np.arange(len(words))
        sizes = size.copy()
        while True:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(live)), at]
            go = low < NONE
            if not go.all():
                done[live[~go]] = parts[~go].astype("<u4")
                parts, ranks, live, at, low = parts[go], ranks[go], live[go], at[go], low[go]
            if not len(live):
                return done, sizes.tolist()
            r = np.arange(len(live))
            parts[r, at] = self.made[low]
            # close the gap that the deleted boundary leaves
            tail = col[:-1] > at[:, None]
            parts[:, :-1] = np.where(tail, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(tail, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            sizes[live] -= 1
            after = np.minimum(at + 1, width - 1)
            ranks[r, at] = np.where(at + 1 < width, self.rank(parts[r, at], parts[r, after]), NONE)
            before = np.maximum(at - 1, 0)
            ranks[r, before] = np.where(at > 0, self.rank(parts[r, before], parts[r, at]), ranks[r, before])

    def long_word(self, word: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i), int(ids[i]), int(ids[i + 1])) for i in np.flatnonzero(first < NONE)]
        heapq.heapify(heap)
        part, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (k := self.pair(part[i], part[j])) is not None:
                heapq.heappush(heap, (k, i, part[i], part[j]))

        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = int(self.made[k]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = nxt[i]
        return out

    def pair(self, a: int, b: int) -> int | None:
        want = a << 20 | b
        at = int(np.searchsorted(self.keys, want))
        return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == want else None

    def pieces(self, text: str) -> list[str]:
        """Stretches of a text that encode alike on their own.

        A cut before a space is safe where no white space follows it; texts with such
        runs are cut into words by the pattern at once.
        """
        spaces = self.spaces[:6] if text.isascii() else self.spaces
        if text.endswith(" ") or any(" " + s in text for s in spaces):
            return self.cut.findall(text)
        head, *rest = text.split(" ")
        return [head] * bool(head) + [" " + p for p in rest]

    def cut_piece(self, p: str) -> list[str]:
        """The pattern's words of a piece; letters with at most a full stop or comma need no search."""
        if p[1:].isalpha() and p[0] == " ":
            return [p]
        if p[-1] in ".," and p[1:-1].isalpha() and p[0] == " ":
            return [p[:-1], p[-1]]
        return self.cut.findall(p)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        cache.age()
        split = []
        for t in texts:
            p: list[str] = []
            for k, s in enumerate(self.split_special.split(t or "") if self.split_special else [t or ""]):
                if k % 2:
                    p.append("\0" + s)
                elif s:
                    p += self.pieces(s)
            split.append(p)
        new = cache.missing(set().union(*split)) if split else []
        cut = [[] if p[:1] == "\0" and p[1:] in self.special else self.cut_piece(p) for p in new]
        words = list({w for ws in cut for w in ws})
        known = dict(zip(words, self.words([w.encode() for w in words]), strict=True))
        for p, ws in zip(new, cut, strict=True):
            if p[:1] == "\0" and p[1:] in self.special:
                cache.young[p] = np.array([self.special[p[1:]]], "<u4").tobytes()
            else:
                cache.young[p] = b"".join(map(known.__getitem__, ws))
        get = cache.young.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian unsigned 32-bit ids; broken UTF-8 becomes U+FFFD."""
        n = np.frombuffer(ids, "<u4")
        out = []
        for lo in range(0, len(n), 1 << 18):
            size = self.token_size[n[lo : lo + (1 << 18)]]
            end = np.cumsum(size)
            shift = self.token_start[n[lo : lo + (1 << 18)]] - (end - size)
            out.append(self.token_flat[np.arange(end[-1]) + np.repeat(shift, size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> RankArrayBpe:
    return RankArrayBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``.

    ``tokenizer``: path of a byte-level BPE file.  ``ids``: binary, little-endian unsigned
    32-bit.  Null and empty texts have no ids and decode to ''.  Special-token strings in a
    text become their ids.  Repeated rows and null ids pass through, one row out for each
    row in; other columns are ignored.  A map without a shuffle: an executor's loss costs the
    tasks it held.
    """

    def work(_, texts):
        bpe = load(tokenizer)
        ids = bpe.encode_batch(texts)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    return map_text(docs, work, "doc_id long, n_tokens long, ids binary, decoded string", id_col, text_col)
