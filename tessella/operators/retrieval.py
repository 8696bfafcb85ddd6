"""Term statistics, lexical and dense retrieval, fusion and reranking.

Everything takes a table of queries; rankings are total: equal scores go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grounding, share, tokens
from .best import Best

K1, B = 1.2, 0.75
#: Rows of queries up to which their side of a join is broadcast; more are shuffled.
BROADCAST_ROWS = 50_000
#: Bytes of queries up to which they are sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Cells of (rows x queries) scored at once in one task.
CELLS = 1 << 21


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(chunks: DataFrame, fields: dict[str, str], key: str = "chunk_id", split=tokens, wanted: DataFrame | None = None) -> DataFrame:
    """(field, term, key, tf, dl, positions) of each analysed field; of the terms in ``wanted`` only, if given.

    Unwanted terms go before anything is shuffled.
    """

    def one(name: str, column: str) -> DataFrame:
        toks = chunks.select(key, split(F.col(column)).alias("_t"))
        at = toks.select(key, F.size("_t").alias("dl"), F.posexplode("_t").alias("pos", "term"))
        if wanted is not None:
            at = at.join(wanted, "term", "left_semi")
        return at.groupBy("term", key).agg(
            F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions")
        ).select(F.lit(name).alias("field"), "term", key, "tf", "dl", "positions")

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in fields.items()])


def field_stats(chunks: DataFrame, fields: dict[str, str], split=tokens) -> DataFrame:
    """(field, n, avgdl)."""
    rows = chunks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.size(split(F.col(c))).alias("dl")) for n, c in fields.items()])).alias("r"))
    return rows.groupBy("r.field").agg(F.count("*").alias("n"), F.avg("r.dl").alias("avgdl"))


def ranked(scored: DataFrame, k: int | None, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25(
    chunks: DataFrame,
    queries: DataFrame,
    k: int | None = 20,
    fields: dict[str, str] | None = None,
    weights: dict[str, float] | None = None,
    split=tokens,
    repeat_terms: bool = False,
    key: str = "chunk_id",
) -> DataFrame:
    """(query_id, rank, key, score): top ``k`` by BM25 over weighted fields; weights must be positive.

    Query terms count once each, or as often as they stand with ``repeat_terms``.  Statistics are
    of all chunks.  Terms of queries that fit into ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` are
    sent to all tasks, which score their own chunks and shuffle ``k`` rows for each query; more are
    joined to postings.  Both ways give the same rows.
    """
    fields, weights = fields or {"text": "chunk_text"}, weights or {}
    if any(weights.get(f, 1.0) <= 0 for f in fields):
        raise ValueError("weights must be positive")
    terms = queries.select("query_id", F.explode(split(F.col("query"))).alias("term"))
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times")) if repeat_terms else terms.distinct().withColumn("times", F.lit(1))
    few = asked.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0)).alias("bytes")).first()
    way = _scored if few["n"] <= BROADCAST_ROWS and few["bytes"] <= BROADCAST_BYTES else _joined
    return way(chunks, asked, k, fields, weights, split, key).select("query_id", "rank", key, "score")


def _joined(chunks, asked, k, fields, weights, split, key) -> DataFrame:
    """BM25 by postings joined to the terms of queries: for more queries than a task can hold."""
    found = postings(chunks, fields, key, split, asked.select("term").distinct()).drop("positions")
    df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    weight = F.create_map(*[F.lit(x) for f in fields for x in (f, float(weights.get(f, 1.0)))])
    stats = F.broadcast(field_stats(chunks, fields, split))  # one row for each field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = found.join(df, ["field", "term"]).join(stats, "field").join(asked, "term")
    scored = parts.groupBy("query_id", key).agg(F.round(F.sum(weight[F.col("field")] * F.col("times") * idf * norm), 6).alias("score"))
    return ranked(scored, k, key)


def _counts(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists, and (row, word, times) of each of ``words`` in them."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    word = pc.fill_null(pc.index_in(lists.flatten(), words), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    cell, times = np.unique((row * len(words) + word)[word >= 0], return_counts=True)
    return size, *(np.divmod(cell, len(words)) if len(words) else (cell, cell)), times


def _scored(chunks, asked, k, fields, weights, split, key) -> DataFrame:
    """BM25 in the tasks that hold the chunks: one scan for the statistics of the asked terms, one to score."""
    spark, names = chunks.sparkSession, list(fields)
    got = asked.toArrow()
    words, ids = pc.unique(got["term"].combine_chunks()), pc.unique(got["query_id"].combine_chunks())
    id_type = asked.schema["query_id"].dataType.simpleString()
    key_type = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(key, *[split(F.col(c)).alias(f"_f{i}") for i, c in enumerate(fields.values())])
    width = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each field: rows with each word, then rows, then all words
        total = np.zeros((len(names), width + 2), np.int64)
        for b in batches:
            for f in range(len(names)):
                size, _, word, _ = _counts(b.column(1 + f), words)
                total[f, :width] += np.bincount(word, minlength=width)
                total[f, width:] += [len(size), size.sum()]
        f, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(at, pa.int64()), pa.array(total[f, at])], names=["f", "at", "n"])

    total = np.zeros((len(names), width + 2))
    sums = rows.mapInArrow(count, "f int, at long, n long").groupBy("f", "at").agg(F.sum("n").alias("n")).toArrow()
    total[sums["f"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    df, n, mean = total[:, :width], total[:, [width]], total[:, width + 1] / np.maximum(total[:, width], 1)
    boost = np.array([[float(weights.get(f, 1.0))] for f in names])
    worth = boost * np.log(1 + (n - df + 0.5) / (df + 0.5))
    # the queries that ask for each word, one behind the other
    word, q = pc.index_in(got["term"], words).to_numpy(), pc.index_in(got["query_id"], ids).to_numpy()
    order = np.lexsort((q, word))
    model = spark.sparkContext.broadcast(
        (worth, mean, np.searchsorted(word[order], np.arange(width + 1)), q[order], got["times"].to_numpy()[order].astype(float))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, mean, first, asker, times = model.value
        best = None
        for b in batches:
            if best is None:
                best = Best(len(ids), k, b.schema.field(0).type)
            step = max(1, CELLS // max(len(ids), 1))
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                sums = np.zeros(part.num_rows * len(ids))
                for f in range(len(names)):
                    size, row, word, tf = _counts(part.column(1 + f), words)
                    norm = K1 * (1 - B + B * size[row] / (mean[f] or 1.0))
                    value = worth[f, word] * tf * (K1 + 1) / (tf + norm)
                    many = first[word + 1] - first[word]
                    ends = np.cumsum(many)
                    for lo, hi in _spans(ends, CELLS):
                        m = many[lo:hi]
                        at = np.repeat(first[word[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        sums += np.bincount(np.repeat(row[lo:hi] * len(ids), m) + asker[at], np.repeat(value[lo:hi], m) * times[at], len(sums))
                sums = sums.reshape(part.num_rows, len(ids))
                best.add(part.column(0), sums, sums > 0)
            if k is None:
                yield from named(best)
        if best is not None:
            yield from named(best)

    def named(best: Best) -> Iterator[pa.RecordBatch]:
        t = best.take()
        yield from pa.table([ids.take(t["q"].combine_chunks()), t["key"], t["score"]], names=["query_id", key, "score"]).to_batches(10_000)

    return ranked(rows.mapInArrow(score, f"query_id {id_type}, `{key}` {key_type}, score double"), k, key)


def _spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries that expand to about ``most`` each."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def phrase(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", field: str = "chunk_text") -> DataFrame:
    """(query_id, key, hits): places where all words of each query stand in a row."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("t")).select("query_id", F.size("t").alias("n"), F.posexplode("t").alias("i", "term"))
    wanted = small(asked.select("term").distinct())
    p = postings(chunks, {"text": field}, key, wanted=wanted).select(key, "term", "positions")
    # where the phrase would have to start, by each of its words
    starts = F.struct("i", F.transform("positions", lambda x: x - F.col("i")).alias("s"))
    both = p.join(small(asked), "term").groupBy("query_id", key, "n").agg(F.collect_list(starts).alias("l")).where("size(l) = n")
    common = F.aggregate("l", F.col("l")[0]["s"], lambda a, x: F.array_intersect(a, x["s"]))
    return both.select("query_id", key, F.size(common).cast("long").alias("hits")).where("hits > 0")


def _units(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Length-one vectors as rows, cut or filled with zeros to ``width``; the zero vector stays, null components count as 0."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(size.max(initial=0))
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), wide))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(norm > 0, norm, 1)
    if width is None or width == wide:
        return out
    return out[:, :width] if width < wide else np.pad(out, ((0, 0), (0, width - wide)))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): exact cosine of (query_id, vector) against all (vec_id, embedding).

    Null vectors take no part; components beyond the shorter vector count as 0.  The stated queries
    meet all rows in blocks of at most ``BROADCAST_BYTES``: a block is sent to all tasks, multiplied
    with the vectors there, and ``k`` rows for each query and task are shuffled.
    """
    spark = vectors.sparkSession
    v = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("q"))
    size = q.agg(F.coalesce(F.sum(F.size("q") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // BROADCAST_BYTES))  # half full by the mean: hashed blocks differ
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"

    def one(b: int) -> DataFrame:
        mine = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        sent = spark.sparkContext.broadcast((mine["query_id"].combine_chunks(), _units(mine["q"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            best = None
            step = max(1, CELLS // max(len(ids), 1))
            for batch in batches:
                if best is None:
                    best = Best(len(ids), k, batch.schema.field(0).type)
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    scores = _units(part.column(1), asked.shape[1]) @ asked.T
                    best.add(part.column(0), scores, np.ones(scores.shape, bool))
            if best is not None:
                t = best.take()
                yield from pa.table([ids.take(t["q"].combine_chunks()), t["key"], t["score"]], names=["query_id", "vec_id", "score"]).to_batches(10_000)

        return v.mapInArrow(run, schema)

    return ranked(reduce(DataFrame.unionByName, map(one, range(blocks))), k, "vec_id").select("query_id", "rank", "vec_id", "score")


def rrf(lists: list[DataFrame], k: int = 20, key: str = "chunk_id", damp: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, rank, key) lists."""
    both = reduce(DataFrame.unionByName, [x.select("query_id", "rank", key) for x in lists])
    scored = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (damp + F.col("rank"))), 6).alias("score"))
    return ranked(scored, k, key).select("query_id", "rank", key, "score")


def weighted_fusion(lists: list[tuple[DataFrame, float]], k: int = 20, key: str = "chunk_id") -> DataFrame:
    """Weighted sum of min-max normed scores; a list of equal scores counts as 1."""
    w = Window.partitionBy("query_id")

    def normed(x: DataFrame, weight: float) -> DataFrame:
        low, high = F.min("score").over(w), F.max("score").over(w)
        return x.select("query_id", key, (F.lit(weight) * F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)).alias("part"))

    both = reduce(DataFrame.unionByName, [normed(x, weight) for x, weight in lists])
    scored = both.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scored, k, key).select("query_id", "rank", key, "score")


def top_up(results: DataFrame, fallback: DataFrame, least: int, key: str = "chunk_id") -> DataFrame:
    """``results`` and, for queries with fewer than ``least``, fallback rows that they lack."""
    have = results.groupBy("query_id").agg(F.count("*").alias("have"))
    more = fallback.join(results.select("query_id", key), ["query_id", key], "left_anti").join(have, "query_id", "left")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key))
    need = F.lit(least) - F.coalesce("have", F.lit(0))
    added = more.withColumn("_n", nth).where(F.col("_n") <= need)
    return results.select("query_id", F.col("rank").cast("long"), key, "score", F.lit(False).alias("added")).unionByName(
        added.select("query_id", (F.coalesce("have", F.lit(0)) + F.col("_n")).cast("long").alias("rank"), key, "score", F.lit(True).alias("added"))
    )


def local_rerank(pool: DataFrame, dense_scores: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The lexical pool in order of dense score; rows without one follow in lexical order."""
    both = pool.select("query_id", key, F.col("rank").alias("_lex"), F.col("score").alias("lexical")).join(
        dense_scores.select("query_id", key, F.col("score").alias("dense")), ["query_id", key], "left"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("dense").isNull(), F.desc("dense"), "_lex")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "lexical", "dense")


def rerank(items: DataFrame, how: str, base: float = 1.0, other: float = 1.0, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """New scores from (query_id, rank, score, q_terms, toks): 'lexical' grounding or 'density' of query terms."""
    q, t = F.filter("q_terms", lambda w: F.length(w) > 1), F.filter("toks", lambda w: F.length(w) > 1)
    extra = grounding(q, t) if how == "lexical" else share(F.size(F.filter(t, lambda w: F.array_contains(q, w))), F.size("toks"))
    scored = items.select("query_id", key, F.col("rank").alias("_prior"), F.round(base * F.col("score") + other * extra, 6).alias("score"))
    return ranked(scored, k, "_prior").select("query_id", "rank", key, "score")
