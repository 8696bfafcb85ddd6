"""A collection that is asked for contexts: chunks, retrieval, assembly and expansion in one object.

Every method takes one query, a list of them or a table (query_id, query), and returns a lazy table.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import parse
from .operators import chunking, context, expansion, retrieval, rewrite, workload
from .operators.context import ContextConfig
from .sources import files

Queries = str | list[str] | DataFrame
COLUMNS = ("chunk_id", "chunk_text", "source", "chunk_index")


@dataclass(frozen=True)
class Options:
    """How texts are cut and searched; ``weights`` names the fields of BM25 among text, source and heading."""

    target: int = 128
    most: int = 256
    overlap: int = 1
    k: int = 20
    analyzer: str = "raw"
    weights: dict[str, float] = field(default_factory=lambda: {"text": 1.0})
    code_neighbours: int = 1
    prose_heading: bool = True
    config: ContextConfig = ContextConfig()

    def fingerprint(self) -> str:
        """Changes with whatever changes chunks or their analysis."""
        made = {k: v for k, v in asdict(self).items() if k in ("target", "most", "overlap", "analyzer")}
        return hashlib.sha256(repr(sorted(made.items())).encode()).hexdigest()


class Document:
    """Chunks (chunk_id, chunk_text, source, chunk_index, token_count, heading, ...) and how they are asked."""

    def __init__(self, chunks: DataFrame, options: Options = Options()):
        lacking = [c for c in COLUMNS if c not in chunks.columns]
        if lacking:
            raise ValueError(f"chunks lack {', '.join(lacking)}")
        for name, value in (("heading", F.lit(None).cast("string")), ("token_count", F.size(F.regexp_extract_all("chunk_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))):
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, value)
        unknown = set(options.weights) - {"text", "source", "heading"}
        if unknown:
            raise ValueError(f"no field {', '.join(sorted(unknown))}")
        self.chunks, self.options, self.skipped = chunks, options, None

    @classmethod
    def from_sections(cls, sections: DataFrame, options: Options = Options()) -> Document:
        """Of (source, section_idx, text, heading, page, line): each section is cut on its own."""
        rows = chunking.by_sections(sections, options.target, options.most, options.overlap)
        return cls(chunking.chunk_index(rows, "source", "section_idx", "piece"), options)

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, source: str = "text", options: Options = Options()) -> Document:
        rows = spark.createDataFrame([(source, 0, text)], "source string, section_idx long, text string")
        return cls.from_sections(rows, options)

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, options: Options = Options()) -> Document:
        """Of all readable files; ``skipped`` holds the others as (source, error)."""
        rows = files.read_folder(spark, path, pattern, recursive)
        out = cls.from_sections(rows.where("error IS NULL"), options)
        out.skipped = rows.where("error IS NOT NULL").select("source", "error")
        return out

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: list[str], options: Options = Options()) -> Document:
        """Of ready chunks, in their order."""
        if not texts:
            raise ValueError("no chunks")
        rows = [(f"chunk-{i}", t, "chunks", i) for i, t in enumerate(texts)]
        return cls(spark.createDataFrame(rows, "chunk_id string, chunk_text string, source string, chunk_index int"), options)

    def n_chunks(self) -> int:
        return self.chunks.count()

    def n_sources(self) -> int:
        return self.chunks.select("source").distinct().count()

    def asked(self, queries: Queries) -> DataFrame:
        """Queries as a table; those of a list are numbered from 0."""
        if isinstance(queries, DataFrame):
            return queries.select("query_id", "query")
        listed = [queries] if isinstance(queries, str) else queries
        return self.chunks.sparkSession.createDataFrame(list(enumerate(listed)), "query_id long, query string")

    def retrieve(self, queries: Queries, k: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score)."""
        o = self.options
        fields = {f: {"text": "chunk_text"}.get(f, f) for f in o.weights}
        return retrieval.bm25(self.chunks, self.asked(queries), k or o.k, fields, o.weights, parse(o.analyzer).tokens)

    def candidates(self, queries: Queries) -> DataFrame:
        return context.characterize(self.retrieve(queries), self.chunks, self.asked(queries), self.options.config)

    def context(self, queries: Queries, budget: int | None = None, neighbours: int = 0, heading: bool = False) -> DataFrame:
        """One row for each query with candidates: chosen ids, the report's columns and ``n_expanded``.

        With neither ``neighbours`` nor ``heading`` the options' defaults hold: queries with a result
        of code take neighbours, those with one under a heading take that heading's first chunk.
        """
        o, cfg = self.options, self.options.config
        cfg = cfg if budget is None else replace(cfg, budget=budget)
        before = context.assemble(context.characterize(found := self.retrieve(queries), self.chunks, self.asked(queries), cfg), cfg)
        flags = None
        if not neighbours and not heading:
            flags, neighbours, heading = expansion.defaults(found, self.chunks), o.code_neighbours, o.prose_heading
        if not neighbours and not heading:
            return before.withColumn("n_expanded", F.lit(0).cast("long"))
        place = {"source": "source", "at": "chunk_index"}
        more = expansion.plan(before, self.chunks, neighbours, heading, flags, **place)
        return expansion.expanded(before, more, self.chunks, cfg.budget, **place)

    def context_with_rewrites(self, queries: Queries, stages: list, budget: int | None = None) -> DataFrame:
        """:meth:`context` of the rewritten queries, without expansion, and the trail ``rewrites``."""
        cfg = self.options.config if budget is None else replace(self.options.config, budget=budget)
        told = rewrite.chain(self.asked(queries), stages)
        asked = told.select("query_id", "query")
        got = context.assemble(context.characterize(self.retrieve(asked), self.chunks, asked, cfg), cfg)
        return got.join(told.select("query_id", "rewrites"), "query_id")

    def analyze(self, queries: Queries) -> DataFrame:
        return context.analyze(self.candidates(queries), self.options.config)

    def diagnose(self, queries: Queries, budget: int | None = None) -> DataFrame:
        """One row for each query, those without candidates included: counts of terms, spread and hints."""
        cfg = self.options.config if budget is None else replace(self.options.config, budget=budget)
        found = self.retrieve(queries)
        made = context.assemble(context.characterize(found, self.chunks, self.asked(queries), cfg), cfg)
        return workload.diagnose(self.asked(queries), found, made, workload.vocabulary(self.chunks), self.n_chunks())

    def texts(self, contexts: DataFrame) -> DataFrame:
        return context.context_text(contexts, self.chunks)

    def citations(self, contexts: DataFrame) -> DataFrame:
        return context.citations(contexts, self.chunks)
