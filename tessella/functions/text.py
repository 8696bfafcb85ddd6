"""Text and vector expressions; all of them built-in functions of Spark."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Latin letters that don't decompose, and their ASCII forms.
PLAIN_LETTERS = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h", "ı": "i", "Ŧ": "T", "ŧ": "t", "Ð": "D", "ð": "d"}
LONG_LETTERS = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}
#: Characters with a meaning in a query language, replaced by spaces.
META = "+-:*?^~\\()[]{}\"<>"
#: English words without content.
STOP_WORDS = (
    "the a an of in on at to for and or but is are was were be been being as by with from that this these those it its he she "
    "they them his her their which who whom what when where how why into than then there here out up down over under do does "
    "did has have had not no can will would should could may might about between during such also"
).split()


def latin_folds() -> tuple[dict[str, str], dict[str, str]]:
    """ASCII forms of the Latin letters beyond ASCII: those of one letter, and longer ones."""
    one, more = dict(PLAIN_LETTERS), dict(LONG_LETTERS)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base and base.isascii() and base.isalpha():
            (one if len(base) == 1 else more).setdefault(c, base)
    return one, more


ONE, MORE = latin_folds()


def fold(c: Column) -> Column:
    """ASCII letters for all Latin ones; other scripts stay."""
    plain = F.translate(c, "".join(ONE), "".join(ONE.values()))
    long = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), MORE.items(), plain)
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(c.rlike(f"[{''.join(MORE)}]"), long).otherwise(plain)


def tokens(c: Column) -> Column:
    """Folded lower-case alphanumeric tokens, in order; null gives none."""
    return F.regexp_extract_all(F.lower(fold(F.coalesce(c, F.lit("")))), F.lit(WORD), F.lit(0))


def content(toks: Column) -> Column:
    """Tokens without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def sanitize(c: Column) -> Column:
    spaced = F.translate(c, META, " " * len(META))
    return F.trim(F.regexp_replace(F.lower(spaced), r"\s+", " "))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams, shorter ones first, of the padded ASCII-alphanumeric form; none for a blank text."""
    core = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), core, F.lit(" "))

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(padded) - n + 1)
        return F.when(F.length(padded) >= n, F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    grams = [of(n) for n in range(low, high + 1)]
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.flatten(F.array(*grams)))


def camel_pieces(c: Column) -> Column:
    """Pieces at lower-upper, acronym-word and letter-digit borders."""
    s = F.regexp_replace(c, r"([a-z])([A-Z])", r"$1 $2")
    s = F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", r"$1 $2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", r"$1 $2")
    s = F.regexp_replace(s, r"([0-9])([A-Za-z])", r"$1 $2")
    return F.filter(F.split(s, r"[^A-Za-z0-9]+"), lambda p: p != "")


def share(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def grounding(query: Column, text: Column) -> Column:
    """Share of the distinct query terms that the text has."""
    return share(F.size(F.array_intersect(query, text)), F.size(F.array_distinct(query)))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


def answer_sentences(c: Column) -> Column:
    """Stretches that end with a line, or with . ? ! before white space or the end: "3.14" is not split."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\n|(?<=[.?!])(?=[ \t\r\f])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def display_order(terms: Column) -> Column:
    """Content words first, stop words behind them."""
    stop = lambda t: t.isin(STOP_WORDS)
    return F.concat(F.filter(terms, lambda t: ~stop(t)), F.filter(terms, stop))


def term_list(terms: Column, most: int) -> Column:
    """Quoted terms, the first ``most`` of them and the number of the others."""
    shown = F.array_join(F.transform(F.slice(terms, 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    more = F.concat(shown, F.lit(", and "), (F.size(terms) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(terms) == 0, "(none)").when(F.size(terms) <= most, shown).otherwise(more)


def percent(share_: Column) -> Column:
    return F.round(100 * share_).cast("int")


def token_savings(before: Column, after: Column) -> Column:
    """Change of tokens in percent; 0 where there were none."""
    return 100.0 * share(after - before, before)


def sentences(c: Column) -> Column:
    """Stretches that end with . ! ? or a line, trimmed, blank ones left out."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")
