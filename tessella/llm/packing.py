"""Hierarchical multi-length packing of token ids into training sequences.

Every document gives its whole 2048-token windows at once.  Its rest goes to the shortest
context tier that holds it.  A tier opens one sequence for each rest in it; the gap is filled
from the shorter tiers, best fit first, and a last rest is cut where nothing fits.  What stays
open when a partition ends is cut into sequences whose sizes are powers of two, which take no
padding.  Sequences of all tiers are dealt to step groups of one token count: each goes where it
leaves the least room, and as sizes are powers of two, all groups of a partition but the last
are full.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import TwoGenerations, prepare, trim
from .hashing import groups

WINDOW = 2048
TIERS = (256, 512, 1024, WINDOW)
END_ID = 1
#: Tokens of a step group, and rests that a packing round holds in memory.
STEP_TOKENS, ROUND = 16 * WINDOW, 4096
#: Words in each generation of the cache, and characters of text whose words are held at a time.
CACHE_WORDS, PART = 100_000, 1 << 20
#: How the tokenizer divides normalized texts, and the same for lower-cased Latin-1.
DIVIDED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa00-9²³¹¼-¾a-zªµºß-öø-ÿ]+")
LETTERS = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch
#: With which special tokens begin.
MARK = "<|"
#: Characters that split() drops but the tokenizer keeps.
KEPT = "\x1c\x1d\x1e\x1f"


class WordTokenizer:
    """Ids of whole texts from cached ids of their words, as the tokenizer divides them.

    Latin-1 texts are divided here, lower-cased; of other texts, the white-space-delimited stretches
    that are Latin-1 are.  All other stretches, and those that may hold a special token, are
    words of their own, which the tokenizer normalizes and divides.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # a task has one core: no pool of threads, each with memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"].get("end_of_word_suffix") != "</w>" or "Lowercase" not in kinds(spec, "normalizer"):
            raise ValueError("words can be cached only for a lower-casing tokenizer whose tokens mark the ends of words")
        split = spec["pre_tokenizer"] or {}
        first = (split.get("pretokenizers") or [split])[0]
        added = [t["content"] for t in spec["added_tokens"]]
        self.divides = (
            set(kinds(spec, "normalizer")) <= {"NFC", "Lowercase", "Replace"}
            and [n["pattern"] for n in steps(spec, "normalizer") if n["type"] == "Replace"] in ([], [{"Regex": "\\s+"}])
            and kinds(spec, "pre_tokenizer") == ["Split", "ByteLevel"]
            and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": DIVIDED}, "Removed", True)
            and all(t.startswith(MARK) for t in added)
        )
        #: For words of lower-case letters, with the same model: nothing to normalize, spaces between them.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache = TwoGenerations(CACHE_WORDS)

    def words(self, text: str) -> list[str]:
        if self.divides and latin(text):
            return WORD.findall(text.lower())
        stretches = text.split(" ") if any(c in text for c in KEPT) else text.split()
        if not self.divides:
            return stretches
        return [w for p in stretches for w in (WORD.findall(p.lower()) if latin(p) else [p])]

    def learn(self, new: list[str]) -> None:
        """Put the ids of new words into the cache.

        Words of lower-case Latin letters are encoded as one text, where each ends with a token
        that closes a word.  All others are encoded one by one.
        """
        known, letters = self.cache.young, []
        if self.divides:
            letters = [w for w in new if LETTERS(w)]
            new = [w for w in new if not LETTERS(w)]
        for lo in range(0, len(letters), 4096):
            part = letters[lo : lo + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, end in zip(part, (cut * 4).tolist(), strict=True):
                    known[w], at = raw[at:end], end
            else:
                known.update(zip(part, self.one_by_one(part), strict=True))
        known.update(zip(new, self.one_by_one(new), strict=True))

    def one_by_one(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def batch(self, texts: list[str | None], end_id: int | None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with ``end_id`` after them."""
        out: list[bytes] = []
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        texts = [t or "" for t in texts]
        for part in groups(texts, PART):
            self.cache.age()
            split = [self.words(texts[i]) for i in part]
            self.learn(self.cache.missing(set().union(*split)))
            get = self.cache.young.__getitem__
            out += [b"".join(map(get, s)) + tail for s in split]
        return out


def steps(spec: dict, part: str) -> list[dict]:
    """The normalizers or pre-tokenizers of a tokenizer, in a sequence or alone."""
    of = spec.get(part) or {}
    return [n for n in of.get("normalizers", of.get("pretokenizers", [of])) if n]


def kinds(spec: dict, part: str) -> list[str]:
    return [n["type"] for n in steps(spec, part)]


def latin(text: str) -> bool:
    """Is a text Latin-1, and without a special token?"""
    if MARK in text:
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


@lru_cache(maxsize=4)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Rest:
    """A stretch of one document that has no sequence yet."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: bytes, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Rest, Rest]:
        return Rest(self.doc, self.ids[: 4 * n], self.start, self.total), Rest(self.doc, self.ids[4 * n :], self.start + n, self.total)


class Packer:
    def __init__(self, first_id: int):
        self.next_id = self.next_group = first_id
        self.groups: list[list[int]] = []  # (room, number) of the open step groups, by room
        self.pools: list[list[tuple[int, int, Rest]]] = [[] for _ in TIERS]
        self.held = self.serial = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % WINDOW
        for at in range(0, whole, WINDOW):
            self.emit([Rest(doc, ids[4 * at : 4 * (at + WINDOW)], at, total)])
        if total > whole:
            self.route(Rest(doc, ids[4 * whole :], whole, total))
        if self.held >= ROUND:
            self.pack()

    def route(self, rest: Rest) -> None:
        tier = next(k for k, size in enumerate(TIERS) if len(rest) <= size)
        self.serial += 1
        insort(self.pools[tier], (len(rest), self.serial, rest))
        self.held += 1

    def take(self, most: int, below: int) -> Rest | None:
        """The longest rest of at most ``most`` tokens in the tiers under ``below``."""
        for pool in reversed(self.pools[:below]):
            if at := bisect_right(pool, (most, self.serial + 1)):
                self.held -= 1
                return pool.pop(at - 1)[2]
        return None

    def shortest(self) -> Rest | None:
        pool = next((p for p in self.pools if p), None)
        if pool is None:
            return None
        self.held -= 1
        return pool.pop(0)[2]

    def pack(self) -> list[Rest]:
        """Pack all pools, longest tier first; returns the rests of the sequence left open."""
        for tier in reversed(range(len(TIERS))):
            size, pool = TIERS[tier], self.pools[tier]
            while pool:
                self.held -= 1
                seq = [pool.pop()[2]]
                gap = size - len(seq[0])
                while gap:
                    rest = self.take(gap, max(tier, 1))
                    if rest is None and (rest := self.shortest()) is not None and len(rest) > gap:
                        rest, back = rest.cut(gap)
                        self.route(back)
                    if rest is None:
                        for r in seq:  # too little is left for this tier: keep it for the next round
                            self.route(r)
                        return seq
                    seq.append(rest)
                    gap -= len(rest)
                self.emit(seq)
        return []

    def finish(self) -> None:
        self.pack()
        left = [r for pool in reversed(self.pools) for _, _, r in reversed(pool)]
        self.pools, self.held = [[] for _ in TIERS], 0
        total = sum(map(len, left))
        for k in reversed(range(WINDOW.bit_length())):
            while total >= 2**k:
                seq, gap = [], 2**k
                while gap:
                    rest = left.pop(0)
                    if len(rest) > gap:
                        rest, back = rest.cut(gap)
                        left.insert(0, back)
                    seq.append(rest)
                    gap -= len(rest)
                self.emit(seq)
                total -= 2**k

    def emit(self, seq: list[Rest]) -> None:
        size = sum(map(len, seq))
        k = bisect_left(self.groups, [size, 0])
        if k == len(self.groups):
            self.groups.append([STEP_TOKENS, self.next_group])
            self.next_group += 1
        room, group = self.groups.pop(k)
        if room > size:
            insort(self.groups, [room - size, group])
        at = 0
        for r in seq:
            self.out.append((r.doc, r.start, len(r), r.ids, r.total, self.next_id, at, size, group))
            at += len(r)
        self.next_id += 1


SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece of each document of ``docs`` in its training sequence.

    ``ids``: the piece's ids, binary, little-endian unsigned 32-bit; ``tier``: the sequence's
    size; ``step_group``: groups of ``STEP_TOKENS`` tokens, of which a partition leaves one short
    at most.  Numbers of sequences and groups hold the partition in their upper bits, so they
    are unique in the whole result.
    A null or empty text is its end id alone.  Repeated rows and null ids are packed as
    documents of their own.  Other columns are ignored.  An empty table gives no rows.
    Partitions pack by themselves, so nothing is shuffled and a lost task is packed anew as a
    whole.
    """
    spark = prepare(docs.sparkSession)
    schema = spark.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = load(tokenizer), Packer(TaskContext.get().partitionId() << 38)

        def flush():
            cols = list(zip(*packer.out, strict=True)) or [[] for _ in arrow]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), words.batch(b.column(1).to_pylist(), end_id), strict=True):
                packer.add(doc, ids)
            yield flush()
        packer.finish()
        yield flush()
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
