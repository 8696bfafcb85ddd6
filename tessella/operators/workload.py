"""Diagnosis of queries, rewriting of templated ones, and evaluation of contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_sentences, grounding, share, tokens
from .rewrite import holds


def vocabulary(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(term, df): chunks whose text has the term."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("query")))).alias("pos", "term"))


def spread(candidates: DataFrame, window: int = 10) -> DataFrame:
    """(query_id, n_candidates, score_spread): (top - kth) / top with k = min(10, n); null under two candidates."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    kth = candidates.withColumn("n", n).where((F.col("rank") == 1) | (F.col("rank") == F.least("n", F.lit(window))))
    got = kth.groupBy("query_id").agg(F.max("n").alias("n_candidates"), F.max("score").alias("top"), F.min("score").alias("kth"))
    value = F.when((F.col("n_candidates") >= 2) & (F.col("top") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("top") - F.col("kth")) / F.col("top"))))
    return got.select("query_id", "n_candidates", F.round(value, 6).alias("score_spread"))


def diagnose(queries: DataFrame, candidates: DataFrame, contexts: DataFrame, vocab: DataFrame, n_chunks: int) -> DataFrame:
    """One row for each query: terms, terms unknown to the corpus, spread and hints in their fixed order."""
    terms = query_terms(queries).join(vocab, "term", "left").select("query_id", F.coalesce("df", F.lit(0)).alias("df"))
    per = terms.groupBy("query_id").agg(
        F.count("*").alias("n_terms"),
        F.count_if(F.col("df") == 0).alias("n_zero"),
        F.count_if(F.col("df") > 0.25 * n_chunks).alias("n_common"),
    )
    base = queries.select("query_id").join(per, "query_id", "left").join(spread(candidates), "query_id", "left").join(
        contexts.select("query_id", "n_selected", "low_confidence"), "query_id", "left"
    )
    v = lambda c: F.coalesce(c, F.lit(0))
    b = base.select(
        "query_id",
        v("n_terms").alias("n_terms"),
        v("n_zero").alias("n_zero"),
        v("n_common").alias("n_common"),
        v("n_candidates").alias("n_candidates"),
        "score_spread",
        (v("n_selected") == 0).alias("empty"),
        F.coalesce("low_confidence", F.lit(True)).alias("low"),
    )
    zero, common = share(F.col("n_zero"), F.col("n_terms")), share(F.col("n_common"), F.col("n_terms"))
    mismatch = (F.col("n_terms") >= 2) & (F.col("empty") | F.col("low")) & (zero >= 0.5)
    hints = F.array_compact(
        F.array(
            F.when(F.col("empty"), "empty_context"),
            F.when(mismatch, "vocab_mismatch"),
            F.when(F.col("low") & ~F.col("empty") & ~mismatch, "low_confidence"),
            F.when((F.col("n_terms") >= 8) & (common >= 0.6), "low_discrimination_query"),
            F.when(F.col("n_terms").between(1, 2) & (F.col("n_candidates") >= 5) & (F.col("score_spread") <= 0.15), "underdetermined_query"),
        )
    )
    return b.select("query_id", "n_terms", "n_zero", "n_candidates", "score_spread", F.array_join(hints, ",").alias("hints"))


def term_details(queries: DataFrame, items: DataFrame, vocab: DataFrame, n_chunks: int) -> DataFrame:
    """(query_id, unmatched_terms, zero_match_terms, max_df_ratio): query terms that no candidate and that no chunk has, in order."""
    seen = items.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("seen"))
    rows = query_terms(queries).join(vocab, "term", "left").join(seen, "query_id", "left")
    rows = rows.select("query_id", "pos", "term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce(F.array_contains("seen", F.col("term")), F.lit(False)).alias("in"))
    listed = lambda when: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("pos", "term")))), lambda x: x["term"]), ",")
    return rows.groupBy("query_id").agg(
        listed(~F.col("in")).alias("unmatched_terms"), listed(F.col("df") == 0).alias("zero_match_terms"), F.round(F.max(F.col("df") / max(n_chunks, 1)), 6).alias("max_df_ratio")
    )


def top_zero_terms(queries: DataFrame, vocab: DataFrame, most: int = 20) -> DataFrame:
    """(term, n, nth): terms unknown to the corpus that most queries have."""
    n = query_terms(queries).join(vocab, "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), "term").limit(most)
    return best.select("term", "n", F.row_number().over(Window.orderBy(F.desc("n"), "term")).cast("long").alias("nth"))


def summarize_diagnoses(diagnoses: DataFrame) -> DataFrame:
    """One row: the rates of the hints and the focus that they suggest."""
    has = lambda h: F.contains("hints", F.lit(h))
    rate = lambda h: F.round(share(F.count_if(has(h)), F.count("*")), 6)
    s = diagnoses.agg(
        F.count("*").alias("n_queries"),
        rate("empty_context").alias("empty_rate"),
        rate("vocab_mismatch").alias("vocab_rate"),
        rate("low_confidence").alias("low_rate"),
        rate("low_discrimination_query").alias("templated_rate"),
        rate("underdetermined_query").alias("under_rate"),
        F.round(F.avg("score_spread"), 6).alias("mean_spread"),
    )
    focus = (
        F.when(F.col("n_queries") < 20, "sample_too_small")
        .when(F.col("vocab_rate") >= 0.20, "vocab_mismatch")
        .when(F.col("templated_rate") >= 0.20, "templated_queries")
        .when(F.col("under_rate") >= 0.20, "underdetermined_queries")
        .when(F.col("low_rate") + F.col("empty_rate") >= 0.30, "weak_retrieval")
        .otherwise("healthy")
    )
    return s.withColumn("focus", focus)


def query_set_terms(queries: DataFrame) -> Column:
    return F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def query_set_report(queries: DataFrame) -> DataFrame:
    """One row: boilerplate terms of a set of queries and how much of the queries they take.

    The boilerplate is at most the words of one query, so it is joined as one broadcast row.
    """
    rows = queries.select("query_id", query_set_terms(queries).alias("t"))
    n = F.lit(rows.count())
    df = rows.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    common = df.where(F.col("df") >= F.ceil(0.8 * n)).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("d"), "term"))), lambda x: x["term"]).alias("bp"))
    parts = rows.where(F.size("t") > 0).join(F.broadcast(common), F.lit(True))
    part = F.size(F.filter("t", lambda w: F.array_contains("bp", w))) / F.size("t")
    got = parts.agg(F.round(F.coalesce(F.avg(part), F.lit(0.0)), 6).alias("share"), F.coalesce(F.first("bp"), F.array().cast("array<string>")).alias("bp"))
    return got.select(
        n.cast("long").alias("n_queries"),
        "share",
        F.array_join("bp", ",").alias("boilerplate"),
        ((F.col("share") >= 0.5) & (F.size("bp") >= 2)).alias("templated"),
        F.when(F.col("share") >= 0.7, "high").when(F.col("share") >= 0.4, "medium").when(F.col("share") >= 0.2, "low").otherwise("none").alias("cost"),
    )


def strip(query: Column, boilerplate: list[str]) -> tuple[Column, Column]:
    """(query without the words whose tokens are boilerplate, sorted removed words)."""
    bad = F.array(*[F.lit(b) for b in boilerplate]).cast("array<string>")
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    is_bad = lambda w: F.arrays_overlap(tokens(w), bad)
    return F.array_join(F.filter(words, lambda w: ~is_bad(w)), " "), F.array_join(F.array_sort(F.filter(words, is_bad)), ",")


def expand(query: Column, classes: list[list[str]], both_ways: bool = False) -> Column:
    """Query with the other members of each class whose key stands in it; members there already stay out."""
    have, added = tokens(query), []
    for members in classes:
        keys = members if both_ways else members[:1]
        hit = reduce(lambda a, b: a | b, [holds(have, tokens(F.lit(k))) for k in keys])
        more = F.filter(F.array(*map(F.lit, members)), lambda m: ~F.array_contains(have, m))
        added.append(F.when(hit, more).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(F.array(query), F.array_distinct(F.concat(*added))), " ")


def evaluate(contexts: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, recall, precision) of the chosen ids against (query_id, chunk_id)."""
    g = gold.groupBy("query_id").agg(F.collect_set("chunk_id").alias("gold"))
    rows = contexts.join(g, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    both = F.size(F.array_intersect("selected", "gold"))
    return rows.select(
        "query_id",
        F.round(F.when(F.size("gold") == 0, 1.0).otherwise(share(both, F.size("gold"))), 6).alias("recall"),
        F.round(F.when(F.size("gold") > 0, share(both, F.size("selected"))), 6).alias("precision"),
    )


def set_coverage(contexts: DataFrame, families: DataFrame) -> DataFrame:
    """(query_id, coverage): share of a query's (query_id, family, chunk_id) families that are chosen as a whole."""
    chosen = contexts.select("query_id", F.explode("selected").alias("chunk_id"), F.lit(1).alias("in"))
    rows = families.join(chosen, ["query_id", "chunk_id"], "left")
    whole = rows.groupBy("query_id", "family").agg((F.count("in") == F.count("*")).alias("all_in"))
    got = whole.groupBy("query_id").agg(share(F.count_if("all_in"), F.count("*")).alias("c"))
    return contexts.select("query_id").join(got, "query_id", "left").select("query_id", F.round(F.coalesce("c", F.lit(1.0)), 6).alias("coverage"))


def summarize(evals: DataFrame) -> DataFrame:
    """One row: means over the values that are there, their numbers, and the lower median of recall."""
    return evals.agg(
        F.count("*").alias("n"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("precision"), 6).alias("mean_precision"),
        F.count("precision").alias("n_precision"),
        lower_median("recall").alias("median_recall"),
    )


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's sentences with at least half of their distinct terms in the context."""
    ctx = F.array_distinct(tokens(context))
    sents = F.transform(answer_sentences(answer), lambda s: F.array_distinct(tokens(s)))
    ok = F.filter(sents, lambda t: F.size(F.array_intersect(t, ctx)) >= F.ceil(F.size(t) / 2))
    return F.when(F.size(sents) > 0, share(F.size(ok), F.size(sents)))


def answer_recall(answer: Column, context: Column) -> Column:
    return grounding(tokens(answer), tokens(context))


def parse_score(raw: Column) -> Column:
    """0..1 from an answer: yes/true, no/false, the first number, a percentage; null if there is none."""
    s = F.lower(F.trim(raw))
    n = F.regexp_extract(s, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    part = F.when(n < 0, 0.0).when(s.rlike(r"[0-9]\s*%") | (n > 1), F.least(n / 100, F.lit(1.0))).otherwise(n)
    return F.when(s.rlike("^(yes|true)"), 1.0).when(s.rlike("^(no|false)"), 0.0).otherwise(part)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return share((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def lower_median(c: str) -> Column:
    """Middle value; of two middle ones the lower."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
