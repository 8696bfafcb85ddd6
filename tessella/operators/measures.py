"""Measures of rankings, judges and corpora, and deliberate corruption of corpora."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import share, tokens

#: The generator that draws resamples, its seed, and the order statistics of the interval.
MULTIPLIER, INCREMENT, SEED, RESAMPLES, LOW, HIGH = 6364136223846793005, 1442695040888963407, 0x5EED, 1000, 24, 974
#: Weights of the parts of an overall score.
WEIGHTS = {
    "context_recall": 3.0, "context_precision": 2.0, "answer_token_recall": 2.0, "set_coverage": 3.0, "faithfulness_lexical": 2.0,
    "relevancy_lexical": 1.5, "correctness_lexical": 2.5, "faithfulness_judged": 4.0, "relevancy_judged": 3.0, "correctness_judged": 4.0,
    "mean_grounding": 1.0, "evidence_density": 1.0, "retained": 1.0,
}
#: What a context of low confidence keeps of its overall score.
DOUBT = 0.2


def overall(columns: list[str], low_confidence: Column) -> Column:
    """Weighted mean of the parts that are there, each held to 0..1; a doubtful context keeps a fifth."""
    parts = [c for c in WEIGHTS if c in columns]
    if not parts:
        return F.lit(0.0)
    value = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * WEIGHTS[c]
    total, weight = F.lit(0.0), F.lit(0.0)
    for c in parts:
        total = total + F.coalesce(value(c), F.lit(0.0))
        weight = weight + F.when(F.col(c).isNotNull(), WEIGHTS[c]).otherwise(0.0)
    return share(total * F.when(low_confidence, DOUBT).otherwise(1.0), weight)


def span_recall(gold: Column, context: Column, distinct: bool = True) -> Column:
    """Share of the gold words that the context has; 1 without gold words."""
    g = F.array_distinct(tokens(gold)) if distinct else tokens(gold)
    c = tokens(context)
    return F.when(F.size(g) == 0, 1.0).otherwise(share(F.size(F.filter(g, lambda w: F.array_contains(c, w))), F.size(g)))


def draws(n: int, resamples: int = RESAMPLES) -> Iterator[list[int]]:
    """Places of each resample of ``n`` values."""
    state = SEED
    for _ in range(resamples):
        out = []
        for _ in range(n):
            state = (state * MULTIPLIER + INCREMENT) % 2**64
            out.append(state % n)
        yield out


def bootstrap(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by..., mean, low, high): the mean and its bootstrap interval; a group is one experiment's values, ordered by ``order``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        xs = [x for x in table[value].to_pylist() if x is not None]
        if xs:
            means = sorted(sum(xs[i] for i in at) / len(xs) for at in draws(len(xs)))
            got = (sum(xs) / len(xs), means[LOW], means[HIGH])
        else:
            got = (0.0, 0.0, 0.0)
        return pa.table({**{k: table[k].slice(0, 1) for k in by}, **{n: [v] for n, v in zip(("mean", "low", "high"), got, strict=True)}})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*by, value, order).groupBy(*by).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), "mean double", "low double", "high double"]))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: number, Pearson correlation and mean absolute difference of two scores."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def ranking(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: recall at 1 and 3, reciprocal rank, and how often a trap stands above the gold.

    ``hits``: (query_id, rank, is_gold, is_trap) of retrieved rows.
    """
    per = hits.groupBy("query_id").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold"), F.min(F.when(F.col("is_trap"), F.col("rank"))).alias("trap"))
    rows = queries.select("query_id").join(per, "query_id", "left")
    at = lambda k: F.avg((F.coalesce("gold", F.lit(2**31 - 1)) <= k).cast("double"))
    above = F.col("trap").isNotNull() & (F.col("gold").isNull() | (F.col("trap") < F.col("gold")))
    return rows.agg(
        F.count("*").alias("n"), at(1).alias("r_at_1"), at(3).alias("r_at_3"), F.avg(F.coalesce(1 / F.col("gold"), F.lit(0.0))).alias("mrr"), F.avg(above.cast("double")).alias("trap_over_gold")
    )


def fill(candidates: DataFrame, budget: int) -> DataFrame:
    """Candidates in rank order up to the first that overflows the budget."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return candidates.withColumn("used", F.sum("token_count").over(order)).where(F.col("used") <= budget)


def repeated(chunks: DataFrame, times: int, key: str = "chunk_id") -> DataFrame:
    """Every chunk ``times`` times; copies bear the number of the copy in their key."""
    copies = chunks.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    name = F.when(F.col("_n") == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("_n").cast("string")))
    return copies.withColumn(key, name).drop("_n")


def misread(chunks: DataFrame, rate: float, seed: int = 7, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """Chunks in whose text about ``rate`` of the words are split in two, as a poor scan does; the same ones each time."""

    def of(k: str, t: str | None) -> str | None:
        if t is None:
            return None
        rng = random.Random(f"{seed}:{k}")

        def one(m: re.Match) -> str:
            w = m[0]
            return w[: len(w) // 2] + " " + w[len(w) // 2 :] if len(w) > 3 and rng.random() < rate else w

        return re.sub(r"\S+", one, t)

    @F.arrow_udf("string")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([of(k, t) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return chunks.withColumn(text, run(F.col(key).cast("string"), F.col(text)))


def definitions(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(term, meaning) of sentences such as: "Term" means ..."""
    pattern = r"[\"“]([^\"“”]{2,80})[\"”]\s+(?:shall\s+)?(?:means?|refers\s+to)\s+([^.;]{3,300})"
    both = F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("m")))
    return chunks.select(both.alias("d")).select(F.trim("d.t").alias("term"), F.trim("d.m").alias("meaning")).distinct()
