"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts, gathered from all training documents: counts of each
byte after each context of up to ``ORDER`` bytes.  A byte that its longest context has seen
takes its share there; otherwise the context escapes to the next shorter one, with the escape
estimated from its number of distinct bytes, and bytes already offered by the longer context
are excluded from the shorter one.  Byte 0xFF, which UTF-8 never holds, opens and ends a text.

Texts are packed into blocks once.  Each block counts its own words and grams and sends them,
cut by hash range, to reducers that hold one range of all blocks; a range of grams has all
grams of its contexts' last ``LOW + 1`` bytes, so it knows every longer context whole.  What is
known of a word or gram in the whole corpus travels back to each block that holds it, in the
block's own order, so no table of the corpus's words or grams is ever in one place.  Only the
grams of order ``LOW`` are broadcast: their number is bounded by the byte values, not by the corpus.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, prepare
from .hashing import SortedHash, U, groups, mix, words_of

HELD_OUT = (7, 2)
ORDER, LOW = 5, 2
BLOCK_BYTES = 16 << 20
#: Grams looked up at a time.
SPAN = 1 << 19
END_WORD = mix(np.array([0x5EED], U))
MARK = b"\xff"


def mask(n: int) -> np.uint64:
    return U(2 ** (8 * n) - 1)


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each byte and of the end, its text): the byte below its ``order`` forerunners."""
    lead = MARK * order
    a = np.frombuffer(b"".join(lead + t + MARK for t in texts), np.uint8).astype(U)
    key = np.zeros(len(a) - order, U)
    for j in range(order + 1):
        key = key << U(8) | a[j : len(a) - order + j]
    sizes = np.array([len(t) + 1 for t in texts])
    # windows that end in the lead of the next text belong to none
    start = np.cumsum(sizes + order) - (sizes + order)
    inside = np.ones(len(key), bool)
    for j in range(order):
        inside[start[1:] - 1 - j] = False
    return key[inside], np.repeat(np.arange(len(texts)), sizes)


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts summed."""
    if not keys:
        return np.empty(0, U), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=~k[:1])) if len(k) else np.empty(0, int)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for part in groups(texts, 1 << 21):
        k = np.sort(grams_of([texts[i] for i in part], order)[0])
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
        keys.append(k[first])
        counts.append(np.diff(np.append(first, len(k))))
    return counted(keys, counts)


def squeeze(a: np.ndarray) -> bytes:
    """An array's type, length and compressed bytes, the like bytes of all values side by side."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return struct.pack("<3sq", a.dtype.str.encode(), len(a)) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unfold(raw: bytes) -> np.ndarray:
    kind, n = struct.unpack("<3sq", raw[:11])
    dtype = np.dtype(kind.decode())
    planes = pa.decompress(raw[11:], n * dtype.itemsize, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def pack(c: np.ndarray) -> bytes:
    """Counts in four bytes each where all fit, else in eight."""
    return squeeze(c.astype("<u4" if c.max(initial=0) < 2**32 else "<u8"))


def unpack(raw: bytes) -> np.ndarray:
    return unfold(raw).astype(np.int64)


def pack_values(v: np.ndarray) -> bytes:
    """Floats, many of them equal: the distinct ones and the place of each."""
    distinct, place = np.unique(v, return_inverse=True)
    first = squeeze(distinct.astype("<f8"))
    return struct.pack("<q", len(first)) + first + pack(place)


def unpack_values(raw: bytes) -> np.ndarray:
    n = 8 + struct.unpack("<q", raw[:8])[0]
    return unfold(raw[8:n])[unpack(raw[n:])]


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The hash range, of ``n``, of each key."""
    return ((mix(keys) >> U(32)) * U(n) >> U(32)).astype(np.int64)


@dataclass
class Level:
    grams: SortedHash
    count: np.ndarray
    contexts: SortedHash
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray


def tight(x: np.ndarray) -> np.ndarray:
    """``x`` in four bytes each where its values fit."""
    return x.astype(np.int32) if x.max(initial=0) < 2**31 else x


class Trie:
    """Counts of bytes after contexts, one level for each context length; those of ``low`` are taken from it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: Trie | None = None):
        self.order = order
        self.levels = list(low.levels) if low else []
        self.top = low.top if low else (np.empty(0, U), np.empty(0, np.int64))
        for j in range(len(self.levels), order + 1):
            k, c = counted([keys & mask(j + 1)], [counts])
            ctx = k >> U(8)
            first = np.flatnonzero(np.diff(ctx, prepend=~ctx[:1])) if len(ctx) else np.empty(0, int)
            sums = lambda v: np.add.reduceat(v, first) if len(first) else v  # noqa: E731, B023
            shorter = self.top[1][np.searchsorted(self.top[0], k & mask(j))] if j else np.zeros(len(k), np.int64)
            grams, contexts = SortedHash(k), SortedHash(ctx[first])
            put = contexts.order
            self.levels.append(
                Level(
                    grams,
                    tight(c[grams.order]),
                    contexts,
                    tight(sums(c)[put]),
                    tight(np.diff(np.append(first, len(k)))[put]),
                    tight(sums(shorter)[put]),
                )
            )
            grams.order = contexts.order = None
            self.top = k, c

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(byte | its forerunners) of each gram."""
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        seen = np.zeros(len(keys), np.int64)  # bytes and counts that the longer context has offered
        offered = np.zeros(len(keys), np.int64)
        for j in range(self.order, -1, -1):
            if not len(live):
                return out
            v, k = self.levels[j], keys[live] & mask(j + 1)
            if not len(v.total):
                continue
            gram = v.grams.find(k)
            ctx = v.contexts.find(k >> U(8))
            known = ctx >= 0
            total = np.where(known, v.total[ctx], 0) - offered[live]
            distinct = np.where(known, v.distinct[ctx], 0) - seen[live]
            room = np.maximum(total + distinct, 1)
            hit = gram >= 0
            out[live[hit]] += np.log10(v.count[gram[hit]] / room[hit])
            escape = ~hit & (distinct > 0)
            out[live[escape]] += np.log10(distinct[escape] / room[escape])
            on = ~hit
            up = live[on]
            offered[up] = np.where(known[on], v.below[ctx[on]], 0)
            seen[up] = np.where(known[on], v.distinct[ctx[on]], 0)
            live = up
        out[live] += np.log10(1 / np.maximum(256 - seen[live], 1))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = []
        for part in groups(texts):
            keys, doc = grams_of([texts[i] for i in part], self.order)
            out.append(np.bincount(doc, self.log10(keys), len(part)))
        return np.concatenate(out) if out else np.empty(0)


#: The low orders of the broadcast at hand, grown once in each worker.
_GROWN: dict[str, Trie] = {}


def grown(sent) -> Trie:
    tag, keys, counts, order = sent.value
    if tag not in _GROWN:
        _GROWN.clear()
        _GROWN[tag] = Trie(keys, counts, order)
    return _GROWN[tag]


def raw(texts: pa.ChunkedArray) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in texts.to_pylist()]


def block_words(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray, list[tuple[range, np.ndarray, np.ndarray]]]:
    """Distinct words of a block, their counts in its training texts, and the words text by text."""
    parts, keys, counts = [], [END_WORD], [np.array([sum(train)])]
    is_train = np.array(train, bool)
    for part in groups(texts):
        h, doc = words_of([texts[i] for i in part])
        parts.append((part, h, doc))
        keys.append(h)
        counts.append(is_train[part.start : part.stop][doc].astype(np.int64))
    k, c = counted(keys, counts)
    return k, c, parts


BLOCKS = "block long, size long, low binary, body binary"
COUNTS = "kind string, bucket long, block long, keys binary, counts binary, types long, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _schema(ddl: str, n: int | None = None) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([pa.field(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", ")[:n])])


def _table(rows: list[tuple], ddl: str, n: int | None = None) -> pa.Table:
    schema = _schema(ddl, n)
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def opened(body: bytes) -> tuple[pa.Table, list[bytes], list[bool]]:
    """A block's rows, its texts, and which of them are learned from."""
    table = pa.ipc.open_stream(body).read_all()
    return table, raw(table["text"]), table["train"].to_pylist()


def split(keys: np.ndarray, by: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(hash range of ``by``, places of its keys in their order) of each range that has some."""
    b = range_of(by, n)
    at = np.argsort(b, kind="stable")
    for sel in np.split(at, np.flatnonzero(np.diff(b[at])) + 1) if len(keys) else []:
        yield int(b[sel[0]]), sel


def suffix(grams: np.ndarray) -> np.ndarray:
    """The last ``LOW + 1`` bytes of each gram's context."""
    return (grams >> U(8)) & mask(LOW + 1)


def fill_blocks(rows: DataFrame, order: int) -> DataFrame:
    """(block, size, low, body): rows of (doc_id, text, train) packed as they stand, with their low grams."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            learn = raw(table.filter(table["train"])["text"])
            k, c = gram_counts(learn, min(order, LOW))
            low = struct.pack("<q", len(first := squeeze(k))) + first + pack(c)
            return _table([(number, size, low, sink.getvalue().to_pybytes())], BLOCKS).to_batches()[0]

        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            at = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist(), 1):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(b.slice(at, i - at))
                    yield block()
                    number, held, size, at = number + 1, [], 0, i
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield block()

    return rows.mapInArrow(fill, BLOCKS)


def low_counts(blocks: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the low order of all blocks, and their counts."""

    def part(batches):
        k, c = np.empty(0, U), np.empty(0, np.int64)
        for b in batches:
            for x in b.column("low").to_pylist():
                n = 8 + struct.unpack("<q", x[:8])[0]
                k, c = counted([k, unfold(x[8:n])], [c, unpack(x[n:])])
        rows = [("l", r, -1, squeeze(k[sel]), pack(c[sel]), 0, 0) for r, sel in split(k, k, ranges)]
        yield from _table(rows, COUNTS).to_batches()

    def total(table: pa.Table) -> pa.Table:
        k, c = counted([unfold(x) for x in table["keys"].to_pylist()], [unpack(x) for x in table["counts"].to_pylist()])
        return _table([("l", table["bucket"][0].as_py(), -1, squeeze(k), pack(c), len(k), int(c.sum()))], COUNTS)

    got = blocks.select("low").mapInArrow(part, COUNTS).groupBy("bucket").applyInArrow(total, COUNTS).collect()
    return counted([unfold(bytes(r["keys"])) for r in got], [unpack(bytes(r["counts"])) for r in got])


def fitting_order(blocks: DataFrame, low: np.ndarray, order: int, nodes: int, ranges: int) -> int:
    """The deepest order, ``order`` at most, whose grams number no more than ``nodes``; order 1 always fits."""

    def part(batches):
        for b in batches:
            for body in b.column("body").to_pylist():
                _, texts, train = opened(body)
                k, _ = gram_counts([t for t, on in zip(texts, train, strict=True) if on], order)
                rows = [("g", r, -1, squeeze(k[sel]), None, 0, 0) for r, sel in split(k, suffix(k), ranges)]
                yield from _table(rows, COUNTS).to_batches()

    def sizes(table: pa.Table) -> pa.Table:
        k = np.concatenate([unfold(x) for x in table["keys"].to_pylist()])
        return _table([("g", j, -1, None, None, len(np.unique(k & mask(j + 1))), 0) for j in range(LOW + 1, order + 1)], COUNTS)

    of = {j: len(np.unique(low & mask(j + 1))) for j in range(1, min(order, LOW) + 1)}
    if order > LOW:
        got = blocks.select("body").mapInArrow(part, COUNTS).groupBy("bucket").applyInArrow(sizes, COUNTS)
        of |= {j: 0 for j in range(LOW + 1, order + 1)}
        of |= {r["bucket"]: r["n"] for r in got.groupBy("bucket").agg(F.sum("types").alias("n")).collect()}
    return max([j for j, n in of.items() if n <= nodes], default=1)


def gather(blocks: DataFrame, sent, order: int, ranges: int) -> DataFrame:
    """Rows (kind, bucket, block, ...) of what all blocks know of each block's words and grams.

    kind 'w': for each block and range the corpus counts of the block's words, in the order of
    its own sorted words; one row of each range bears the range's numbers of types and tokens.
    kind 'g': likewise the log10 probabilities of the block's grams.
    """

    def count(batches):
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body").to_pylist(), strict=True):
                _, texts, train = opened(body)
                words, n, _ = block_words(texts, train)
                learn = gram_counts([t for t, on in zip(texts, train, strict=True) if on], order)
                other = gram_counts([t for t, on in zip(texts, train, strict=True) if not on], order)[0]
                k, c = counted([learn[0], other], [learn[1], np.zeros(len(other), np.int64)])
                for kind, k, c, by in (("w", words, n, words), ("g", k, c, suffix(k))):  # noqa: B020
                    rows = [(kind, r, block, squeeze(k[sel]), pack(c[sel])) for r, sel in split(k, by, ranges)]
                    yield from _table(rows, COUNTS, 5).to_batches()

    def total(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        keys = [unfold(k) for k in table["keys"].to_pylist()]
        k, c = counted(keys, [unpack(c) for c in table["counts"].to_pylist()])
        if kind == "g":
            trie = Trie(k[c > 0], c[c > 0], order, grown(sent))
            known = np.concatenate([trie.log10(k[at : at + SPAN]) for at in range(0, len(k), SPAN)])
            write, n, n_all = pack_values, 0, 0
        else:
            known, write, n, n_all = c, pack, int((c > 0).sum()), int(c.sum())
        rows = [
            (kind, bucket, block, None, write(known[np.searchsorted(k, own)]), 0, 0)
            for block, own in zip(table["block"].to_pylist(), keys, strict=True)
        ]
        rows[0] = (*rows[0][:5], n, n_all)
        return _table(rows, COUNTS)

    each = blocks.select("block", "body").mapInArrow(count, COUNTS.rsplit(", ", 2)[0])
    return each.groupBy("kind", "bucket").applyInArrow(total, COUNTS)


def placed(by: np.ndarray, ranges: int, answers: list[np.ndarray]) -> np.ndarray:
    """The answers of the ranges, in the order of the keys that were split by ``by``."""
    got = np.concatenate(answers)
    out = np.empty_like(got)
    out[np.argsort(range_of(by, ranges), kind="stable")] = got
    return out


def score_documents(
    docs: DataFrame, order: int = ORDER, nodes: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    The order is the same at every size, unless ``nodes`` bounds the grams of the deepest one.
    Null texts count as empty: one token, the end.  A null id is never learned from, so it
    counts as held out.  Repeated rows are counted and scored as often as they stand; other
    columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = cut(fill_blocks(rows.select("doc_id", "text", (~held).alias("train")), order))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-size // BLOCK_BYTES))
    low, n_low = low_counts(blocks, ranges)
    if nodes is not None:
        lowered = fitting_order(blocks, low, order, nodes, ranges)
        if lowered < min(order, LOW):
            low, n_low = counted([low & mask(lowered + 1)], [n_low])
        order = lowered
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, low, n_low, min(order, LOW)))
    made = cut(gather(blocks, sent, order, ranges))
    known = made.where("kind = 'w'").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = known[0] or 0, known[1] or 0
    bottom = np.log10(tokens + types + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], SCORES)
        table, texts, train = opened(left["body"][0].as_py())
        words, _, parts = block_words(texts, train)
        got = sorted(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["counts"].to_pylist(), strict=True))
        c = placed(words, ranges, [unpack(x) for kind, _, x in got if kind == "w"])
        gain, there = np.log10(c + 1), (c > 0).astype(np.int64)
        end = int(np.searchsorted(words, END_WORD[0]))
        n, k, base = np.ones(len(texts), np.int64), np.full(len(texts), there[end]), np.full(len(texts), gain[end])
        for part, h, doc in parts:
            at, span = np.searchsorted(words, h), slice(part.start, part.stop)
            n[span] += np.bincount(doc, minlength=len(part))
            k[span] += np.bincount(doc, there[at], len(part)).astype(np.int64)
            base[span] += np.bincount(doc, gain[at], len(part))
        grams, _ = gram_counts(texts, order)
        logs = placed(suffix(grams), ranges, [unpack_values(x) for kind, _, x in got if kind == "g"])
        score = np.empty(len(texts))
        for part in groups(texts):
            keys, doc = grams_of([texts[i] for i in part], order)
            score[part.start : part.stop] = np.bincount(doc, logs[np.searchsorted(grams, keys)], len(part))
        return pa.table(
            [table["doc_id"], [not t for t in train], n, k, np.full(len(n), tokens), base - n * bottom, score],
            schema=_schema(SCORES),
        )

    answers = made.select("kind", "block", "bucket", "counts")
    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
