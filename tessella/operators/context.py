"""Context assembly: from candidates of each query to a context within a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, grounding, jaccard, share, tokens

STRATEGIES = ("raw_topk", "distractor_filtered", "redundancy_pruned", "max_density", "reasoning_preserving", "auto")


@dataclass(frozen=True)
class ContextConfig:
    """Tunables of assembly; ``budget`` None admits everything."""

    strategy: str = "reasoning_preserving"
    budget: int | None = 8192
    min_grounding: float = 0.10
    max_similarity: float = 0.9
    max_cosine: float = 0.92
    min_link: float = 0.12
    auto_gate: int = 1500
    low_confidence: float = 0.10
    preserve_order: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; one of {', '.join(STRATEGIES)}")


def characterize(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, cfg: ContextConfig = ContextConfig(), key: str = "chunk_id") -> DataFrame:
    """Candidates with terms, grounding, density and the distractor flag; grounding is rounded to 6 places.

    An ``embedding`` of the chunks goes along.
    """
    from .retrieval import small

    q = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("q_terms"))
    vector = [c for c in ("embedding",) if c in chunks.columns]
    rows = candidates.join(chunks.select(key, "chunk_text", F.greatest("token_count", F.lit(1)).alias("token_count"), *vector), key)
    rows = rows.join(small(q), "query_id").withColumn("toks", tokens(F.col("chunk_text")))
    hits = F.size(F.filter("toks", lambda t: F.array_contains("q_terms", t)))
    out = rows.select(
        "query_id",
        "rank",
        key,
        "score",
        "q_terms",
        "toks",
        "token_count",
        F.array_distinct("toks").alias("terms"),
        F.round(grounding(F.col("q_terms"), F.col("toks")), 6).alias("grounding"),
        F.round(share(hits, F.col("token_count")), 6).alias("density"),
        *vector,
    )
    return out.withColumn("is_distractor", F.col("grounding") < cfg.min_grounding)


def _fill(items: Column, cfg: ContextConfig, prune: Column) -> Column:
    """Greedy fill in order: what doesn't fit, or repeats what is in, is passed over.

    Two items with vectors are told apart by their cosine, others by their terms.
    """
    budget = F.lit(cfg.budget if cfg.budget is not None else 2**62).cast("long")
    kept = F.array().cast("array<struct<terms:array<string>,v:array<double>>>").alias("kept")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"), kept)

    def alike(t: Column, x: Column) -> Column:
        dense = t["v"].isNotNull() & x["v"].isNotNull()
        return F.when(dense, cosine(t["v"], x["v"]) > cfg.max_cosine).otherwise(jaccard(t["terms"], x["terms"]) >= cfg.max_similarity)

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["token_count"] <= budget
        fresh = ~prune | ~F.exists(a["kept"], lambda t: alike(t, x))
        return F.when(
            fits & fresh,
            F.struct(
                (a["used"] + x["token_count"]).alias("used"),
                F.concat(a["ids"], F.array(x["id"])).alias("ids"),
                F.when(prune, F.concat(a["kept"], F.array(F.struct(x["terms"].alias("terms"), x["v"].alias("v"))))).otherwise(a["kept"]).alias("kept"),
            ),
        ).otherwise(a)

    return F.aggregate(items, start, step)


def assemble(items: DataFrame, cfg: ContextConfig = ContextConfig(), key: str = "chunk_id") -> DataFrame:
    """One row for each query: the resolved strategy, chosen ids in order, and the report.

    A query's candidates, at most the retriever's ``k``, are gathered in one row; texts stay out of it.
    """
    vector = (F.col("embedding") if "embedding" in items.columns else F.lit(None)).cast("array<double>").alias("v")
    item = F.struct(
        "rank", F.col(key).alias("id"), F.col("token_count").cast("long").alias("token_count"), "grounding", "density", "is_distractor", "terms", vector
    )
    per = items.groupBy("query_id").agg(
        F.sort_array(F.collect_list(item)).alias("all"),
        F.sum(F.col("token_count").cast("long")).alias("input_tokens"),
        F.count("*").alias("n_input"),
        F.max("grounding").alias("best"),
    )
    every = F.col("all")
    seeds = F.filter(every, lambda x: ~x["is_distractor"])
    rescued = F.filter(
        every, lambda x: x["is_distractor"] & F.exists(F.col("seeds"), lambda s: jaccard(x["terms"], s["terms"]) >= cfg.min_link)
    )
    per = per.withColumn("seeds", seeds).withColumn("rescued", rescued)
    resolved = (
        F.when(F.col("input_tokens") <= cfg.auto_gate, "raw_topk").otherwise("reasoning_preserving")
        if cfg.strategy == "auto"
        else F.lit(cfg.strategy)
    )
    down = lambda field: lambda a, b: (
        F.when(a[field] > b[field], -1).when(a[field] < b[field], 1).when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)
    )
    ordered = (
        F.when(F.col("strategy") == "distractor_filtered", F.col("seeds"))
        .when(F.col("strategy") == "max_density", F.array_sort("all", down("density")))
        .when(
            F.col("strategy") == "reasoning_preserving",
            F.concat(F.array_sort("seeds", down("grounding")), F.array_sort("rescued", down("grounding"))),
        )
        .otherwise(every)
    )
    filled = per.withColumn("strategy", resolved).withColumn("ordered", ordered)
    filled = filled.withColumn("filled", _fill(F.col("ordered"), cfg, F.col("strategy") == "redundancy_pruned"))
    ids = F.col("filled.ids")
    count = lambda f: F.size(F.filter("all", f)).cast("long")
    in_seeds = F.size(F.filter("seeds", lambda s: F.array_contains(ids, s["id"])))
    return filled.select(
        "query_id",
        "strategy",
        ids.alias("selected"),
        "n_input",
        "input_tokens",
        F.size(ids).cast("long").alias("n_selected"),
        F.col("filled.used").alias("total_tokens"),
        count(lambda x: x["is_distractor"]).alias("n_distractors"),
        F.size(F.filter("rescued", lambda s: F.array_contains(ids, s["id"]))).cast("long").alias("n_rescued"),
        F.round(share(count(lambda x: x["is_distractor"]), F.col("n_input")), 6).alias("distractor_ratio"),
        F.round(F.when(F.size("seeds") == 0, 1.0).otherwise(share(in_seeds, F.size("seeds"))), 6).alias("retained"),
        F.coalesce(
            F.forall(F.filter("all", lambda x: F.array_contains(ids, x["id"])), lambda x: x["grounding"] <= cfg.low_confidence), F.lit(True)
        ).alias("low_confidence"),
    )


def analyze(items: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """One row for each query on all of its candidates: nothing is chosen; what a pruning would rescue is counted."""
    per = items.groupBy("query_id").agg(
        F.collect_list(F.struct("is_distractor", "terms")).alias("all"),
        F.count("*").alias("n_input"),
        F.sum(F.col("token_count").cast("long")).alias("input_tokens"),
        F.count_if("is_distractor").alias("n_bad"),
        F.bool_and(F.col("grounding") <= cfg.low_confidence).alias("low_confidence"),
    )
    per = per.withColumn("seeds", F.filter("all", lambda x: ~x["is_distractor"]))
    linked = F.filter("all", lambda x: x["is_distractor"] & F.exists("seeds", lambda s: jaccard(x["terms"], s["terms"]) >= cfg.min_link))
    return per.select(
        "query_id",
        "n_input",
        "input_tokens",
        F.round(share(F.col("n_bad"), F.col("n_input")), 6).alias("distractor_ratio"),
        F.size(linked).cast("long").alias("n_rescuable"),
        "low_confidence",
        F.when(F.col("input_tokens") <= cfg.auto_gate, "passthrough").otherwise("prune").alias("decision"),
    )


def economics(items: DataFrame) -> DataFrame:
    """Tokens, relevant share, waste and density of each query's unselected candidates."""
    t = F.col("token_count").cast("long")
    return items.groupBy("query_id").agg(
        F.sum(t).alias("total_tokens"),
        F.round(share(F.sum(F.when(~F.col("is_distractor"), t).otherwise(0)), F.sum(t)), 6).alias("relevant_share"),
        F.round(share(F.count_if("is_distractor"), F.count("*")), 6).alias("distractor_ratio"),
        F.sum(F.when(F.col("is_distractor"), t).otherwise(0)).alias("waste_tokens"),
        # in the order of ranks, so that the last digit doesn't hang on the order of rows
        F.round(F.aggregate(F.sort_array(F.collect_list(F.struct("rank", "density"))), F.lit(0.0), lambda a, x: a + x["density"]) / F.count("*"), 6).alias("mean_density"),
    )


def spread_of_vectors(items: DataFrame, budget: int) -> DataFrame:
    """(query_id, mean_cosine, utilisation): the mean over all pairs of a query's candidates with vectors, null under two, and tokens for each one of the budget."""
    t = F.col("token_count").cast("long")
    per = items.groupBy("query_id").agg(F.sum(t).alias("tokens"), F.sort_array(F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct("rank", F.col("embedding").cast("array<double>").alias("v"))))).alias("l"))
    later = lambda i: F.filter("l", lambda y, j: j > i)
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(later(i), lambda y: cosine(x["v"], y["v"]))))
    mean = F.when(F.size("l") > 1, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs))
    return per.select("query_id", F.round(mean, 5).alias("mean_cosine"), F.round(share(F.col("tokens"), F.lit(budget)), 6).alias("utilisation"))


def render(contexts: DataFrame) -> DataFrame:
    """(query_id, report): one text for each row of :func:`assemble`."""
    line = lambda name, *parts: F.concat_ws(" ", F.lit(f"{name}:"), *parts)
    percent = lambda c: F.concat(F.round(100 * F.col(c)).cast("int").cast("string"), F.lit("%"))
    kept = F.concat(F.col("n_selected").cast("string"), F.lit(" of "), F.col("n_input").cast("string"))
    tokens_ = F.concat(F.col("total_tokens").cast("string"), F.lit(" of "), F.col("input_tokens").cast("string"))
    warning = F.when(F.col("n_selected") == 0, "warning: the context is empty").when(F.col("low_confidence"), "warning: no chunk holds much of the query")
    lines = [line("strategy", F.col("strategy")), line("chunks", kept), line("tokens", tokens_), line("distractors", percent("distractor_ratio")), line("evidence retained", percent("retained")), warning]
    return contexts.select("query_id", F.concat_ws("\n", *lines).alias("report"))


def citations(contexts: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, ord, key, ...): where each chosen chunk is from, by the columns among source, page, heading and line that there are."""
    places = [c for c in ("source", "page", "heading", "line") if c in chunks.columns]
    rows = contexts.select("query_id", F.posexplode("selected").alias("ord", key))
    return rows.join(chunks.select(key, *places), key, "left").select("query_id", "ord", key, *places)


def selected_rows(contexts: DataFrame) -> DataFrame:
    """(query_id, ord, chunk_id) of every chosen chunk."""
    return contexts.select("query_id", F.posexplode("selected").alias("ord", "chunk_id"))


def context_text(contexts: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, context): the chosen texts, a blank line between them."""
    rows = selected_rows(contexts).join(chunks.select(F.col(key).alias("chunk_id"), "chunk_text"), "chunk_id")
    got = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "chunk_text"))).alias("c"))
    return got.select("query_id", F.array_join(F.transform("c", lambda x: x["chunk_text"]), "\n\n").alias("context"))


def neighbours(seeds: DataFrame, chunks: DataFrame, n: int = 1, key: str = "chunk_id", source: str = "doc_id", at: str = "piece") -> DataFrame:
    """(query_id, seed, companion, dist): chunks up to ``n`` places from each seed in its source."""
    s = seeds.join(chunks.select(key, source, at), key).select("query_id", F.col(key).alias("seed"), source, F.col(at).alias("_at"))
    s = s.select("*", F.explode(F.array(*[F.lit(d * e) for d in range(1, n + 1) for e in (-1, 1)])).alias("dist"))
    return s.withColumn(at, F.col("_at") + F.col("dist")).join(chunks.select(source, at, F.col(key).alias("companion")), [source, at]).select(
        "query_id", "seed", "companion", F.col("dist").cast("long").alias("dist")
    )


def heading_openers(seeds: DataFrame, chunks: DataFrame, key: str = "chunk_id", source: str = "source", heading: str = "lang", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """(query_id, seed, companion): the first chunk under the seed's source and heading, unless it is the seed."""
    first = chunks.groupBy(source, heading).agg(F.min_by(key, F.struct(*order)).alias("companion"))
    s = seeds.join(chunks.select(key, source, heading), key)
    return s.join(first, [source, heading]).where(F.col(key) != F.col("companion")).select("query_id", F.col(key).alias("seed"), "companion")


def preserve_order(rows: DataFrame, source: str, index: str) -> DataFrame:
    """Rows with ``ord``: their place by source and running number."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(source).orderBy(index)).cast("long") - 1)
