"""Sections of texts: lines, blank-line blocks, markdown headings, file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of code and of data files.
CODE = "py ts tsx js jsx mjs cjs rs go java kt kts c h cpp hpp cc hh cs rb php sh bash zsh sql swift scala lua r pl ml ex exs".split()
DATA = "json jsonl ndjson yaml yml toml csv tsv xml".split()


def kind(source: Column) -> Column:
    """code, data or prose by the extension of a name."""
    ext = F.lower(F.regexp_extract(source, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(CODE), "code").when(ext.isin(DATA), "data").otherwise("prose")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, content)."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("line"), "content")


def line_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, n_lines, n_chars): stretches of lines between blank ones."""
    rows = lines(docs, key, text)
    blank = F.length(F.trim("content")) == 0
    order = Window.partitionBy(key).orderBy("line")
    island = F.sum(blank.cast("int")).over(order)
    return (
        rows.withColumn("island", island)
        .where(~blank)
        .groupBy(key, "island")
        .agg(F.min("line").alias("line"), F.count("*").alias("n_lines"), F.sum(F.length("content")).alias("n_chars"))
        .drop("island")
    )


def page_heading(text: Column) -> Column:
    """First non-blank line if it looks like a heading, else null."""
    first = F.element_at(F.concat(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.array(F.lit(""))), 1)
    fits = F.length(first).between(4, 80) & first.rlike(r"\p{L}") & ~first.rlike(r"[.,;:?!0-9]$")
    lead = F.lower(first)
    return F.when(fits & ~lead.rlike(r"^(page |p\. |\[|[-*•])"), first)


#: Words that may stand before a declaration, and words that open one.
MODIFIERS = "pub export default public private protected static final async open override abstract".split()
KEYWORDS = "def class fn func function impl struct enum trait interface module package sub".split()


def symbol(line: Column) -> Column:
    """The declaration that a line of code opens, without a closing brace or colon, at most 80 characters; else null."""
    text = F.trim(line)
    opens = text.rlike(rf"^(?:(?:{'|'.join(MODIFIERS)}) +)*(?:{'|'.join(KEYWORDS)}) ")
    return F.when(opens, F.substring(F.regexp_replace(F.regexp_replace(text, r"[\s{]+$", ""), r"[\s:]+$", ""), 1, 80))


def code_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_idx, text, page, heading, line): stretches between blank lines under the nearest declaration up to their first line."""
    rows = lines(docs, key, text)
    blank = F.length(F.trim("content")) == 0
    order = Window.partitionBy(key).orderBy("line")
    marked = rows.withColumn("sym", F.last(symbol(F.col("content")), ignorenulls=True).over(order)).withColumn("island", F.sum(blank.cast("int")).over(order))
    got = marked.where(~blank).groupBy(key, "island").agg(
        F.min("line").alias("line"), F.min_by("sym", "line").alias("heading"), F.sort_array(F.collect_list(F.struct("line", "content"))).alias("c")
    )
    body = F.rtrim(F.array_join(F.transform("c", lambda x: x["content"]), "\n"))
    return got.select(key, F.col("line").cast("int").alias("section_idx"), body.alias("text"), F.lit(None).cast("int").alias("page"), "heading", F.col("line").cast("int").alias("line"))


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_idx, heading, line, section): a section starts at each heading line, which it keeps."""
    rows = lines(docs, key, text)
    head = F.regexp_extract("content", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
    is_head = F.col("content").rlike(r"^#{1,6}\s+\S")
    order = Window.partitionBy(key).orderBy("line")
    marked = rows.select("*", F.sum(is_head.cast("int")).over(order).cast("long").alias("section_idx"), F.when(is_head, head).alias("h"))
    got = marked.groupBy(key, "section_idx").agg(
        F.max("h").alias("heading"), F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "content"))).alias("c")
    )
    out = got.select(key, "section_idx", "heading", "line", F.array_join(F.transform("c", lambda x: x["content"]), "\n").alias("section"))
    return out.where(F.length(F.trim("section")) > 0)


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_idx, heading, line, section): headings of both styles, without YAML front matter.

    A section starts at its heading, which it keeps without a Setext underline (three or more ``=``
    or ``-`` below a line of text).  Front matter is what stands between a first line ``---`` and the
    next one; unclosed, it is text.  Texts without any heading go by :func:`line_blocks`' rule, one
    section for each stretch between blank lines.  Null texts and blank sections give no rows.
    """
    per = Window.partitionBy(key)
    order = per.orderBy("line")
    fence = F.col("content").rlike(r"^---\s*$")
    rows = lines(docs, key, text).withColumn("_end", F.min(F.when(fence & (F.col("line") > 1), F.col("line"))).over(per))
    rows = rows.withColumn("_open", F.bool_or(fence & (F.col("line") == 1)).over(per)).where(~F.col("_open") | F.col("_end").isNull() | (F.col("line") > F.col("_end")))
    atx = F.col("content").rlike(r"^#{1,6}\s+\S")
    plain = (F.length(F.trim("content")) > 0) & ~atx
    rows = rows.withColumn("_rule", F.col("content").rlike(r"^(?:={3,}|-{3,})\s*$") & F.coalesce(F.lag(plain).over(order), F.lit(False)))
    # a rule below a rule underlines nothing
    rows = rows.withColumn("_rule", F.col("_rule") & ~F.coalesce(F.lag("_rule").over(order), F.lit(False)))
    rows = rows.withColumn("_setext", F.coalesce(F.lead("_rule").over(order), F.lit(False)) & plain & ~F.col("_rule"))
    rows = rows.where(~F.col("_rule")).withColumn("_head", atx | F.col("_setext"))
    name = F.when(atx, F.regexp_extract("content", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)).when(F.col("_setext"), F.trim("content"))
    blank = F.length(F.trim("content")) == 0
    opens = F.when(F.bool_or("_head").over(per), F.col("_head")).otherwise(blank)
    marked = rows.withColumn("section_idx", F.sum(opens.cast("long")).over(order)).withColumn("_h", name)
    got = marked.groupBy(key, "section_idx").agg(
        F.max(F.when(F.col("_head"), F.col("_h"))).alias("heading"),
        F.min(F.when(~blank, F.col("line"))).alias("line"),
        F.sort_array(F.collect_list(F.struct("line", "content"))).alias("c"),
    )
    body = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["content"]), "\n"), r"^\n+|\s+$", "")
    return got.select(key, "section_idx", "heading", "line", body.alias("section")).where(F.length(F.trim("section")) > 0)
