"""Rewriting of queries and chunks: stripping boilerplate, adding members of a vocabulary, and chains of both.

A stage maps a text column to a struct (text, matched, added, removed); ``chain`` applies stages
one after another and keeps a record of each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import ENGLISH, RAW, Analyzer

NONE = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(NONE)


def normalize_word(w: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))


def holds(tokens: Column, needle: Column) -> Column:
    """Does an array hold another one as a stretch?  An empty one is in none."""
    last = F.size(tokens) - F.size(needle)
    at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return (F.size(needle) > 0) & (last >= 0) & F.exists(at, lambda i: F.slice(tokens, i + 1, F.size(needle)) == needle)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


@dataclass(frozen=True)
class Stripper:
    """Drops the words of a query that are boilerplate by their terms, or by their letters where they have no term."""

    boilerplate: tuple[str, ...]
    analyzer: Analyzer = ENGLISH
    name: str = field(default="strip", init=False)

    def bad(self, w: Column) -> Column:
        forms = strings(list(self.boilerplate))
        terms = F.array_distinct(F.flatten(F.transform(forms, self.analyzer.tokens))) if self.analyzer is RAW else self.analyzer.terms(F.lit(" ".join(self.boilerplate)))
        plain = F.transform(forms, normalize_word)
        return F.arrays_overlap(self.analyzer.tokens(w), terms) | F.array_contains(plain, normalize_word(w))

    def table(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with a struct ``out``; each distinct word is analysed once, in one pass beside the rows."""
        if self.analyzer is RAW:
            return rows.withColumn(out, self.record(F.col(text), lambda w: self.bad(w)))
        one = rows.select(F.explode(words(F.col(text))).alias("_w")).distinct()
        removed = one.where(self.bad(F.col("_w"))).agg(F.collect_set("_w").alias("_bad"))
        # at most the surface forms of the boilerplate: a bounded set
        joined = rows.crossJoin(F.broadcast(removed))
        return joined.withColumn(out, self.record(F.col(text), lambda w: F.array_contains("_bad", w))).drop("_bad")

    def record(self, c: Column, is_bad: Callable[[Column], Column]) -> Column:
        gone = F.filter(words(c), is_bad)
        return F.struct(
            F.array_join(F.filter(words(c), lambda w: ~is_bad(w)), " ").alias("text"),
            F.array_sort(F.array_distinct(F.transform(gone, normalize_word))).alias("matched"),
            F.array().cast(NONE).alias("added"),
            F.array_sort(gone).alias("removed"),
        )

    def effect(self, rows: DataFrame, text: str = "query") -> DataFrame:
        """``rows`` with what the stripper does: terms before and after, forms that fired, that did not, and that
        did not though their letters stand in the text."""
        got = self.table(rows, text, "_r")
        forms, low = strings(list(self.boilerplate)), F.lower(F.col(text))
        fired = lambda f: F.array_contains("_r.matched", normalize_word(f))
        unused = F.filter(forms, lambda f: ~fired(f))
        out = got.withColumn("stripped", F.col("_r.text")).withColumn("original_tokens", self.analyzer.tokens(F.col(text)))
        out = out.withColumn("stripped_tokens", self.analyzer.tokens(F.col("stripped"))).withColumn("removed_terms", F.filter(forms, fired))
        return out.withColumn("unused_boilerplate", unused).withColumn(
            "probable_silent_no_op", F.filter(unused, lambda f: (f != "") & F.contains(low, F.lower(f)))
        ).drop("_r")


@dataclass(frozen=True)
class Vocabulary:
    """Adds the other members of a class whose key stands in the text as a stretch of terms."""

    classes: tuple[tuple[str, ...], ...]
    both_ways: bool = False
    analyzer: Analyzer = RAW
    name: str = "expand"

    def column(self, c: Column) -> Column:
        have = self.analyzer.tokens(c)
        empty = F.array().cast(NONE)
        hits, more = [], []
        for members in self.classes:
            keys = members if self.both_ways else members[:1]
            hit = [F.when(holds(have, self.analyzer.tokens(F.lit(k))), F.array(F.lit(k))).otherwise(empty) for k in keys]
            there = F.size(F.concat(*hit)) > 0
            hits += hit
            more.append(F.when(there, F.filter(strings(list(members)), lambda m: ~holds(have, self.analyzer.tokens(m)))).otherwise(empty))
        added = first_of_each(F.concat(*more)) if more else empty
        return F.struct(
            F.array_join(F.concat(F.array(c), added), " ").alias("text"),
            (F.array_distinct(F.concat(*hits)) if hits else empty).alias("matched"),
            added.alias("added"),
            empty.alias("removed"),
        )

    def table(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        return rows.withColumn(out, self.column(F.col(text)))


def first_of_each(a: Column) -> Column:
    """An array without members that repeat an earlier one in another case."""
    low = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def enrich(chunks: DataFrame, vocabulary: Vocabulary, text: str = "chunk_text") -> DataFrame:
    """Chunks whose text bears the members that its terms call for."""
    return vocabulary.table(chunks, text, "_v").withColumn(text, F.col("_v.text")).drop("_v")


def chain(rows: DataFrame, stages: list, text: str = "query", trail: str = "rewrites") -> DataFrame:
    """``rows`` with ``text`` rewritten by every stage in turn; ``trail`` records (stage, before, after, matched, added, removed)."""
    records = []
    out = rows
    for n, stage in enumerate(stages):
        out = stage.table(out, text, "_s").withColumn(
            f"_t{n}",
            F.struct(F.lit(stage.name).alias("stage"), F.col(text).alias("before"), F.col("_s.text").alias("after"), "_s.matched", "_s.added", "_s.removed"),
        ).withColumn(text, F.col("_s.text")).drop("_s")
        records.append(f"_t{n}")
    kind = "array<struct<stage:string,before:string,after:string,matched:array<string>,added:array<string>,removed:array<string>>>"
    return out.withColumn(trail, F.array(*records).cast(kind)).drop(*records)
