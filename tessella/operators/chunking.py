"""Chunkers: tables of chunks from tables of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD


def fixed(docs: DataFrame, size: int = 128, overlap: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` words that share ``overlap``; the text is the slice of the source.

    Adds ``piece``, ``chunk_id``, ``chunk_text`` and ``token_count``; texts without words have no chunk.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than it")
    stride = size - overlap
    words = docs.select(
        *[c for c in docs.columns if c != text],
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.split(text, WORD, -1).alias("_g"),
    ).where(F.size("_w") > 0)
    n = F.size("_w")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))

    def window(p: Column) -> Column:
        at = p * stride
        w = F.slice("_w", at + 1, F.lit(size))
        # the gap before each word but the first goes with it
        gaps = F.slice("_g", at + 1, F.size(w))
        inner = F.array_join(F.zip_with(F.slice(gaps, 2, F.lit(size)), F.slice(w, 2, F.lit(size)), lambda g, x: F.concat(g, x)), "")
        return F.struct(p.alias("piece"), F.concat(F.element_at(w, 1), inner).alias("chunk_text"), F.size(w).alias("token_count"))

    # windows leave the row as small structs: the arrays of a whole text are not copied into each chunk
    cut = words.select(*[c for c in docs.columns if c != text], F.inline(F.transform(F.sequence(F.lit(0), last), window)))
    return cut.select(
        *[c for c in docs.columns if c != text],
        "piece",
        F.concat_ws(":", F.col(key).cast("string"), F.col("piece").cast("string")).alias("chunk_id"),
        "chunk_text",
        "token_count",
    )


def fold_lines(lines: Column, most: int) -> Column:
    """Greedy packing of lines into chunks of at most ``most`` words; a longer line stands alone."""
    count = lambda x: F.greatest(F.lit(1), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))
    packed = F.aggregate(
        lines,
        start,
        lambda a, x: F.when(
            (a["n"] > 0) & (a["n"] + count(x) > most),
            F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.array(x).alias("open"), count(x).alias("n")),
        ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x)).alias("open"), (a["n"] + count(x)).alias("n"))),
        lambda a: F.concat(a["done"], F.filter(F.array(a["open"]), lambda o: F.size(o) > 0)),
    )
    return F.transform(packed, lambda p: F.array_join(p, "\n"))


def verbatim(docs: DataFrame, most: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of whole lines for code and data."""
    chunks = docs.select(key, F.posexplode(fold_lines(F.split(text, "\n"), most)).alias("piece", "chunk_text"))
    return chunks.where(F.length(F.trim("chunk_text")) > 0)


def _packed(sentences: list[str], target: int, most: int, overlap: int, apart: Callable[[list[str], str], bool]) -> Iterator[tuple[str, int]]:
    count = lambda s: len(s.split())
    held: list[str] = []
    total = 0
    for s in sentences:
        n = count(s)
        if held and (total + n > target or apart(held, s) and 2 * total >= target):
            yield " ".join(held), total
            held = held[-overlap:] if overlap and len(held) > overlap else []
            total = sum(map(count, held))
        if n > most:
            yield " ".join([*held, s]), n
            held, total = [s][-overlap:] if overlap else [], n if overlap else 0
            continue
        held.append(s)
        total += n
        if total >= most:
            yield " ".join(held), total
            held = held[-overlap:] if overlap and len(held) > overlap else []
            total = sum(map(count, held))
    if held:
        yield " ".join(held), total


def sentence(docs: DataFrame, target: int = 128, most: int = 256, overlap: int = 1, cohesion: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences packed to ``target`` words; the last ``overlap`` ones open the next chunk.

    With ``cohesion`` a chunk of at least half the target also ends where the next sentence
    shares too few words with it.
    """
    from ..functions.text import sentences as split

    def apart(held: list[str], s: str) -> bool:
        a, b = set(" ".join(held).lower().split()), set(s.lower().split())
        return len(a & b) / len(a | b) < cohesion if a | b else False

    judge = apart if cohesion is not None else lambda held, s: False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (k, i, c, n)
                for k, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for i, (c, n) in enumerate(_packed(parts, target, most, overlap, judge))
            ]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32()), strict=True)],
                names=[key, "piece", "chunk_text", "token_count"],
            )

    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"
    return docs.select(F.col(key).cast(kind), split(F.col(text)).alias("_s")).mapInArrow(run, f"{key} {kind}, piece int, chunk_text string, token_count int")


def adaptive(docs: DataFrame, target: int = 256, most: int = 384, cohesion: float = 0.15, key: str = "doc_id", text: str = "text") -> DataFrame:
    return sentence(docs, target, most, 0, cohesion, key, text)


def by_sections(sections: DataFrame, target: int = 128, most: int = 256, overlap: int = 1) -> DataFrame:
    """(chunk_id, source, section_idx, piece, chunk_text, token_count, kind, heading, page, line) of (source, section_idx, text, heading, page, line).

    Prose is packed by sentences, code and data by whole lines, each section on its own: no chunk
    crosses sections, and each bears its section's marks.  Columns that ``sections`` lacks are null.
    Null and blank texts give no rows; tokens are counted as in :func:`fixed`.
    """
    from ..sources.sections import kind

    types = {"source": "string", "section_idx": "long", "heading": "string", "page": "int", "line": "int"}
    marks = [(F.col(c) if c in sections.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    # the marks travel as one value, so that nothing has to be joined
    rows = sections.select(F.to_json(F.struct(*marks)).alias("_m"), kind(F.col("source")).alias("kind"), "text")
    prose = sentence(rows.where("kind = 'prose'"), target, most, overlap, key="_m").select("_m", "piece", "chunk_text")
    other = verbatim(rows.where("kind <> 'prose'"), most, "_m").select("_m", F.col("piece").cast("int").alias("piece"), "chunk_text")
    both = prose.unionByName(other).withColumn("m", F.from_json("_m", ", ".join(f"{c} {t}" for c, t in types.items())))
    return both.where(F.length(F.trim("chunk_text")) > 0).select(
        F.concat_ws(":", "m.source", "m.section_idx", "piece").alias("chunk_id"),
        "m.source",
        "m.section_idx",
        "piece",
        "chunk_text",
        F.size(F.regexp_extract_all("chunk_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token_count"),
        kind(F.col("m.source")).alias("kind"),
        "m.heading",
        "m.page",
        "m.line",
    )


def chunk_index(chunks: DataFrame, source: str = "source", *order: str) -> DataFrame:
    """Running number of each chunk within its source."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1)
