"""Analyzers: named pipelines from a text column to a column of terms."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .stem import stemmed

#: Longest token, in characters, that the stemming pipeline keeps.
LONGEST = 40


@dataclass(frozen=True)
class Analyzer:
    """``tokens`` maps a text column to its terms; ``subwords``: queries count each gram as often as it stands."""

    name: str
    tokens: Callable[[Column], Column]
    subwords: bool = False

    def terms(self, c: Column) -> Column:
        return F.array_distinct(self.tokens(c))


def with_pieces(toks: Column) -> Column:
    """Each token, followed by its pieces where its case or digits split it."""

    def of(t: Column) -> Column:
        pieces = T.camel_pieces(t)
        return F.when(t.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"), F.concat(F.array(t), pieces)).otherwise(F.array(t))

    return F.flatten(F.transform(toks, of))


def snowball_tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Stems of the folded lower-case tokens of at most ``LONGEST`` characters, without stop words."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(T.WORD), F.lit(0))
    cut = with_pieces(F.filter(raw, lambda t: F.length(t) <= LONGEST))
    low = F.transform(cut, lambda t: F.lower(T.fold(t)))
    stop = T.STOP_WORDS if stop_words is None else stop_words
    return stemmed(F.filter(low, lambda t: ~t.isin(list(stop))) if stop else low)


RAW = Analyzer("raw", T.tokens)
ENGLISH = Analyzer("english", snowball_tokens)


def english(stop_words: list[str]) -> Analyzer:
    """The English pipeline with stop words of one's own."""
    return Analyzer("english", lambda c: snowball_tokens(c, stop_words))


def char_ngram(low: int = 3, high: int = 5) -> Analyzer:
    if not 1 <= low <= high:
        raise ValueError("need 1 <= min <= max")
    return Analyzer(f"char_ngram_{low}_{high}", lambda c: T.char_ngrams(F.coalesce(c, F.lit("")), low, high), True)


def parse(spec: str) -> Analyzer:
    """``raw``, ``english`` or ``char_ngram[:MIN-MAX]``."""
    if spec in ("raw", "english"):
        return RAW if spec == "raw" else ENGLISH
    m = re.fullmatch(r"char_ngram(?::(\d+)-(\d+))?", spec)
    if m is None:
        raise ValueError(f"unknown analyzer {spec!r}: expected raw, english or char_ngram[:MIN-MAX]")
    return char_ngram(*map(int, m.groups())) if m[1] else char_ngram()


def grounding_score(query: Column, text: Column, analyzer: Analyzer = ENGLISH) -> Column:
    """Share of the query's terms that the text has."""
    return T.grounding(analyzer.terms(query), analyzer.tokens(text))


def link_strength(a: Column, b: Column, analyzer: Analyzer = ENGLISH) -> Column:
    """Jaccard similarity of two texts' terms; 0 where either has none."""
    return T.jaccard(analyzer.terms(a), analyzer.terms(b))
