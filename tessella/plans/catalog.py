"""The catalogue of queries over the standard tables; each runs over whole tables and texts.

Chunks are fixed windows of ``documents`` (128 words, 16 shared); queries are the passages of
``benchmark``; a query's gold chunks are the candidates that hold nearly all of its terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, expansion, measures, retrieval, workload
from ..operators.context import ContextConfig
from ..sources import sections

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}
BUDGET = 2048


def query(f: Query) -> Query:
    CATALOG[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``documents``; one of fewer splits than the cluster has cores is dealt out to all of them."""
    docs, cores = table(spark, d, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed(texts(spark, d).select("doc_id", "text", "source", "lang"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("chunk_text"), F.col("p_type").alias("source"), F.col("p_brand").alias("heading")
    )


def part_queries(spark: SparkSession, d: str) -> DataFrame:
    """One query for each distinct part name."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    return names.select("query_id", F.col("p_name").alias("query"))


def lexical(spark: SparkSession, d: str, k: int | None = 20) -> DataFrame:
    return retrieval.bm25(chunks(spark, d), passages(spark, d), k)


def items(spark: SparkSession, d: str, cfg: ContextConfig = ContextConfig(), pool: DataFrame | None = None) -> DataFrame:
    return context.characterize(lexical(spark, d) if pool is None else pool, chunks(spark, d), passages(spark, d), cfg)


def flat(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("selected", F.array_join("selected", ","))


def built(spark: SparkSession, d: str, strategy: str, budget: int | None = BUDGET, pool: DataFrame | None = None) -> DataFrame:
    cfg = ContextConfig(strategy=strategy, budget=budget)
    return context.assemble(items(spark, d, cfg, pool), cfg)


# scans, sections, tokens


@query
def scan_documents(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query
def kind_projection(spark, d):
    return table(spark, d, "pages").select("page_id", sections.kind(F.regexp_extract("url", r"^[^?#]*", 0)).alias("kind"))


@query
def blank_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(F.length(F.trim("line")) > 0).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query
def html_line_blocks(spark, d):
    return sections.line_blocks(table(spark, d, "pages"), "page_id", "html")


@query
def page_heading_rule(spark, d):
    return table(spark, d, "documents").select("doc_id", sections.page_heading(F.col("text")).alias("heading"))


@query
def markdown_heading_carry(spark, d):
    rows = sections.markdown(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "section_idx", "heading", "line", F.length("section").cast("long").alias("n_chars"))


@query
def tokens_raw(spark, d):
    toks = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def tokens_char_ngram(spark, d):
    return parts(spark, d).select(F.explode(T.char_ngrams(F.col("chunk_text"), 3, 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query
def camel_split(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    return rows.select(F.explode(T.camel_pieces(F.col("w"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@query
def sanitize_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitize(F.col("text")).alias("query"))


# chunks and statistics


@query
def chunk_fixed(spark, d):
    return chunks(spark, d).select("chunk_id", "piece", "token_count", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


@query
def chunk_verbatim(spark, d):
    return chunking.verbatim(texts(spark, d)).select("doc_id", "piece", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


@query
def chunk_sentence(spark, d):
    return chunking.sentence(texts(spark, d))


@query
def chunk_adaptive(spark, d):
    return chunking.adaptive(texts(spark, d))


@query
def chunk_index_stamp(spark, d):
    rows = chunking.chunk_index(chunks(spark, d).withColumn("s", F.col("doc_id")), "s", "piece")
    return rows.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query
def field_stats(spark, d):
    got = retrieval.field_stats(chunks(spark, d), {"text": "chunk_text", "source": "source", "heading": "lang"})
    return got.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query
def vocab_df(spark, d):
    return workload.vocabulary(chunks(spark, d))


@query
def postings_tf(spark, d):
    p = retrieval.postings(chunks(spark, d), {"text": "chunk_text"})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query
def query_set_report(spark, d):
    users = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return workload.query_set_report(users)


# retrieval


@query
def bm25_topk(spark, d):
    return lexical(spark, d)


@query
def bm25_multifield(spark, d):
    return retrieval.bm25(chunks(spark, d), passages(spark, d), 20, {"text": "chunk_text", "source": "source", "heading": "lang"})


@query
def bm25_weighted(spark, d):
    weights = {"text": 1.0, "source": 1.0, "heading": 2.0}
    return retrieval.bm25(parts(spark, d), part_queries(spark, d), 20, {"text": "chunk_text", "source": "source", "heading": "heading"}, weights)


@query
def bm25_subword(spark, d):
    grams = lambda c: T.char_ngrams(c, 3, 4)
    return retrieval.bm25(parts(spark, d), part_queries(spark, d), 20, split=grams, repeat_terms=True)


@query
def bm25_phrase(spark, d):
    return retrieval.phrase(parts(spark, d), part_queries(spark, d))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query
def dense_topk(spark, d):
    return retrieval.dense(*vectors(spark, d), k=10)


@query
def hybrid_local_rerank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    pool = lexical(spark, d, 50)
    q = passages(spark, d).select("query_id").join(v, F.col("query_id") == F.col("doc_id")).select("query_id", F.col("embedding").alias("q"))
    rows = pool.join(chunks(spark, d).select("chunk_id", "doc_id"), "chunk_id").join(v, "doc_id").join(q, "query_id")
    scores = rows.select("query_id", "chunk_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return retrieval.local_rerank(pool, scores, 20)


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    multi = retrieval.bm25(chunks(spark, d), passages(spark, d), 20, {"text": "chunk_text", "source": "source", "heading": "lang"}, {"heading": 3.0})
    by_density = retrieval.rerank(items(spark, d), "density", 0.0, 1.0, 20)
    return multi, by_density


@query
def fuse_rrf(spark, d):
    return retrieval.rrf(list(two_lists(spark, d)))


@query
def fuse_weighted(spark, d):
    a, b = two_lists(spark, d)
    return retrieval.weighted_fusion([(a, 0.7), (b, 0.3)])


@query
def min_candidates_topup(spark, d):
    pool = lexical(spark, d, 20)
    return retrieval.top_up(pool.where("score >= 60"), pool, 10)


@query
def rerank_lexical(spark, d):
    return retrieval.rerank(items(spark, d), "lexical", 0.01, 1.0)


@query
def rerank_density(spark, d):
    return retrieval.rerank(items(spark, d), "density", 0.01, 1.0)


@query
def rerank_fusion(spark, d):
    rows = hybrid_local_rerank(spark, d).select("query_id", "rank", "chunk_id", F.round(F.col("lexical") + 2.0 * F.coalesce("dense", F.lit(0.0)), 6).alias("score"))
    return retrieval.ranked(rows.withColumnRenamed("rank", "_prior"), 10, "_prior").select("query_id", "rank", "chunk_id", "score")


# contexts


def _strategy(name: str) -> Query:
    def run(spark, d):
        return flat(built(spark, d, name))

    run.__name__ = f"ctx_{name}"
    return query(run)


for _name in context.STRATEGIES:
    _strategy(_name)


def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the vector of their document, where it has one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = items(spark, d).withColumn("doc_id", F.substring_index("chunk_id", ":", 1).cast("long"))
    return rows.join(v, "doc_id", "left").drop("doc_id")


@query
def ctx_redundancy_cosine(spark, d):
    cfg = ContextConfig(strategy="redundancy_pruned", budget=BUDGET)
    return flat(context.assemble(embedded_items(spark, d), cfg))


@query
def ctx_vector_spread(spark, d):
    return context.spread_of_vectors(embedded_items(spark, d), BUDGET)


@query
def ctx_report(spark, d):
    return context.render(built(spark, d, "auto"))


@query
def ctx_filter(spark, d):
    return flat(built(spark, d, "distractor_filtered", None))


@query
def ctx_economics(spark, d):
    return context.economics(items(spark, d))


@query
def ctx_text(spark, d):
    got = context.context_text(built(spark, d, "auto"), chunks(spark, d))
    return got.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query
def ctx_preserve_order(spark, d):
    return context.preserve_order(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return context.selected_rows(built(spark, d, "auto")).select("query_id", "chunk_id")


@query
def expand_neighbors(spark, d):
    return context.neighbours(seeds(spark, d), chunks(spark, d), 2)


@query
def expand_heading(spark, d):
    return context.heading_openers(seeds(spark, d), chunks(spark, d))


def widened(spark: SparkSession, d: str, automatic: bool) -> DataFrame:
    c, pool = chunks(spark, d), lexical(spark, d)
    before = built(spark, d, "auto", 4096, pool)
    flags = expansion.defaults(pool, c, heading="lang") if automatic else None
    more = expansion.plan(before, c, 1, True, flags, section=("source", "lang"))
    return flat(expansion.expanded(before, more, c, 4096)).select("query_id", "selected", "total_tokens", "n_selected", "n_expanded")


@query
def ctx_expanded(spark, d):
    return widened(spark, d, False)


@query
def ctx_expanded_auto(spark, d):
    return widened(spark, d, True)


# diagnosis, rewriting, evaluation


@query
def score_spread(spark, d):
    return workload.spread(lexical(spark, d))


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    c, pool = chunks(spark, d), lexical(spark, d)  # one ranking for both uses
    return workload.diagnose(passages(spark, d), pool, built(spark, d, "auto", pool=pool), workload.vocabulary(c), c.count())


@query
def diag_hints(spark, d):
    return diagnosed(spark, d)


@query
def diag_summary(spark, d):
    return workload.summarize_diagnoses(diagnosed(spark, d))


@query
def rw_strip(spark, d):
    kept, removed = workload.strip(F.col("text"), ["the", "of", "and", "de", "la", "der"])
    return table(spark, d, "benchmark").select("item_id", kept.alias("kept"), removed.alias("removed"))


CLASSES = [["the", "article"], ["de", "von", "of"], ["and", "und", "et"]]


@query
def rw_vocab(spark, d):
    return table(spark, d, "benchmark").select("item_id", workload.expand(F.col("text"), CLASSES).alias("query"))


@query
def rw_vocab_bidirectional(spark, d):
    return table(spark, d, "benchmark").select("item_id", workload.expand(F.col("text"), CLASSES, True).alias("query"))


def gold(spark: SparkSession, d: str, pool: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id): candidates with nine tenths of the passage's terms."""
    return items(spark, d, pool=pool).where("grounding >= 0.9").select("query_id", "chunk_id")


@query
def eval_recall_precision(spark, d):
    pool = lexical(spark, d)
    return workload.evaluate(built(spark, d, "raw_topk", pool=pool), gold(spark, d, pool))


@query
def eval_set_coverage(spark, d):
    pool = lexical(spark, d)
    families = gold(spark, d, pool).select("query_id", F.substring_index("chunk_id", ":", 1).alias("family"), "chunk_id")
    return workload.set_coverage(built(spark, d, "raw_topk", 512, pool), families)


@query
def eval_summary(spark, d):
    return workload.summarize(eval_recall_precision(spark, d))


@query
def embed_hashing(spark, d):
    from ..operators import embedding

    got = embedding.embed(parts(spark, d), embedding.hashing, "chunk_text")
    return got.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query
def eval_answer_recall(spark, d):
    got = context.context_text(built(spark, d, "raw_topk"), chunks(spark, d)).join(passages(spark, d), "query_id")
    return got.select(
        "query_id",
        F.round(workload.answer_recall(F.col("query"), F.col("context")), 6).alias("answer_recall"),
        F.round(workload.faithfulness(F.col("query"), F.col("context")), 6).alias("faithfulness"),
    )


@query
def bench_grid(spark, d):
    base = items(spark, d)
    out = None
    for strategy in ("raw_topk", "distractor_filtered", "max_density", "reasoning_preserving"):
        for budget in (256, 1024):
            cfg = ContextConfig(strategy=strategy, budget=budget)
            one = context.assemble(base, cfg).agg(
                F.round(F.avg("n_selected"), 6).alias("mean_selected"), F.round(F.avg("total_tokens"), 6).alias("mean_tokens")
            ).select(F.lit(strategy).alias("strategy"), F.lit(budget).alias("budget"), "mean_selected", "mean_tokens")
            out = one if out is None else out.unionByName(one)
    return out


@query
def recall_at_k(spark, d):
    pool = lexical(spark, d)
    g = gold(spark, d, pool).select("query_id", "chunk_id", F.lit(True).alias("is_gold"))
    hits = pool.join(g, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = passages(spark, d).select("query_id").join(hits, "query_id", "left")
    at = lambda k: F.round(F.avg((F.coalesce("first", F.lit(10**6)) <= k).cast("double")), 6)
    return rows.agg(
        F.count("*").alias("n"), at(1).alias("r_at_1"), at(3).alias("r_at_3"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


@query
def prf_terms(spark, d):
    pool = items(spark, d).select("query_id", "q_terms", F.explode("toks").alias("term"))
    stop = [w for w in T.STOP_WORDS]
    fresh = pool.where(~F.array_contains("q_terms", F.col("term")) & (F.length("term") >= 3) & ~F.col("term").isin(stop))
    n = fresh.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "term"))
    return n.withColumn("nth", nth.cast("long")).where("nth <= 5")


@query
def drop_low_idf(spark, d):
    c = chunks(spark, d)
    most = F.lit(c.count()) * 0.2
    terms = workload.query_terms(passages(spark, d)).join(workload.vocabulary(c), "term", "left")
    kept = terms.where((F.coalesce("df", F.lit(0)) <= F.ceil(most)) | (F.length("term") < 3))
    got = kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("query"))
    return got


@query
def latency_percentile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        workload.lower_median("value").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count("*").alias("n")
    )


@query
def judge_parse_score(spark, d):
    raw = F.element_at(F.split("text", r"\s+"), -1)
    return table(spark, d, "conversations").select("conv_id", "turn", workload.parse_score(raw).alias("score"))


@query
def diag_terms(spark, d):
    c = chunks(spark, d)
    return workload.term_details(passages(spark, d), items(spark, d), workload.vocabulary(c), c.count())


@query
def diag_top_zero_terms(spark, d):
    return workload.top_zero_terms(passages(spark, d), workload.vocabulary(chunks(spark, d)))


@query
def ctx_analyze(spark, d):
    return context.analyze(items(spark, d))


@query
def span_recall(spark, d):
    got = context.context_text(built(spark, d, "raw_topk"), chunks(spark, d)).join(passages(spark, d), "query_id")
    of = lambda distinct: F.round(measures.span_recall(F.col("query"), F.col("context"), distinct), 6)
    return got.select("query_id", of(True).alias("by_set"), of(False).alias("by_list"))


@query
def judge_agreement(spark, d):
    got = measures.agreement(table(spark, d, "labels"), "quality", "toxic")
    return got.select("n", F.round("pearson", 6).alias("pearson"), F.round("mae", 6).alias("mae"))


@query
def greedy_fill(spark, d):
    rows = lexical(spark, d).join(chunks(spark, d).select("chunk_id", "token_count"), "chunk_id")
    return measures.fill(rows, 1000).select("query_id", "rank", "chunk_id", "used")


@query
def tokens_english(spark, d):
    from ..functions.analysis import ENGLISH

    toks = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.explode(ENGLISH.tokens(F.col("text"))).alias("term"))
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def bootstrap_ci(spark, d):
    rows = items(spark, d).select(F.lit("bm25").alias("run"), F.concat_ws(":", "query_id", "rank").alias("o"), "grounding")
    return measures.bootstrap(rows, ["run"], "grounding", "o")


@query
def f_beta(spark, d):
    lab = table(spark, d, "labels").agg(
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("tp"),
        F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("fp"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("fn"),
    )
    return lab.select("tp", "fp", "fn", F.round(workload.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0), 6).alias("f2"))


@query
def incremental_upsert(spark, d):
    from ..sources.incremental import upsert

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.md5(F.col("text").cast("binary")).alias("stamp"), F.length("text").cast("long").alias("length"))
    old = docs.where("length > 1000").withColumn("stamp", F.when(F.col("length") > 2000, F.col("stamp")).otherwise("old"))
    return upsert(old, docs)


@query
def windowed_audit(spark, d):
    from ..streaming.audit import audit

    return audit(table(spark, d, "events"))
