"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over one scan; nothing is shuffled and no user function
runs.  ``measures`` gives the counts, ``compile_rules`` turns the table into one verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Very frequent words of the languages that the rules admit.
STOP_WORDS = (
    "the of and to in a is that for it with on as be at by this or an are "
    "le la les de des et en un une du que est pour dans qui sur au pas avec ce "
    "der die das und in zu den von mit ist ein eine nicht auf im für dem es auch als "
    "el la los las de y en que un una por con para es del se no su al lo"
).split()
#: (name, measure, smallest, largest); None leaves a side open.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 50, None),
    ("word_length", "mean_word_chars", 1.5, 20),
    ("symbols", "symbol_ratio", None, 0.15),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("repeated_words", "repeat_word_ratio", None, 0.5),
]


def held(c: Column) -> Column:
    """``c``, which the optimizer can't move into a filter or a lambda.

    There each element of an array would compute the whole array anew.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios of whole texts; columns of ``docs`` named in ``keep`` go along.

    A null text counts as an empty one: all counts 0, all ratios 0.  Stop words count as often as
    they stand, in any case of letters.  Repeated rows and null ids each give a row.
    """
    t = F.col("_t")
    split = docs.select(*keep, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        *keep,
        "_id",
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        held(F.filter(F.split(t, WHITE + "+"), lambda w: w != "")).alias("_w"),
        held(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)).alias("_lines"),
    )
    w = F.col("_w")
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    counted = split.select(
        *keep,
        "_id",
        "word_chars",
        "n_symbols",
        F.size("_w").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))).alias("n_stop_words"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        held(F.when(F.size("_w") >= 3, F.slice(window, F.lit(1), F.size("_w") - 2))).alias("_h"),
    )
    # only texts with a window found twice are sorted: equal hashes then stand side by side
    pairs = F.array_sort(F.transform("_h", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = counted.select("*", held(F.when(again, pairs)).alias("_s"))
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
    spots = placed.select("*", held(F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x.p)))).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    whole = spots.select("*", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    return whole.select(
        *keep,
        F.col("_id").alias(id_col),
        *[F.col(c).cast("long").alias(c) for c in counts],
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_stop_words", "n_words").alias("stop_word_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def compile_rules(rules: list[tuple[str, str, float | None, float | None]] = RULES) -> tuple[Column, Column]:
    """(verdict, array of the names of the rules that fail) of a threshold table."""
    passed = {
        name: reduce(
            lambda a, b: a & b,
            [F.col(m) >= low] * (low is not None) + [F.col(m) <= high] * (high is not None),
            F.lit(True),
        )
        for name, m, low, high in rules
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    return reduce(lambda a, b: a & b, passed.values(), F.lit(True)), failed


def apply_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``failed_rules`` of each row of ``docs``.

    Null and empty texts have no words, so they fail.  Rows are judged one by one: repeated
    rows and null ids each give a row; other columns are ignored; an empty table gives no rows.
    """
    verdict, failed = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).select(
        "*", base.alias("base_failed"), (verdict & ~base).alias("kept"), failed.alias("failed_rules")
    )


def filter_documents(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Null and empty texts fail.  Repeated rows stay or go together; an empty table stays empty.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.lit(0).alias("_one"), F.col(text_col))
    verdict, _ = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(whole, "_one", text_col, keep=("_row",)).where(verdict & ~base).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tok AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d
), win AS (
  SELECT doc_id, p, x || ' ' || lead(x) OVER v || ' ' || lead(x, 2) OVER v AS g FROM tok WINDOW v AS (PARTITION BY doc_id ORDER BY p)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY 1
), lin AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w, lambda x: list_contains([STOPS], lower(x)))) AS n_stop
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.15 AND n_stop / n_words >= 0.02
    AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept
FROM m
""".replace("STOPS", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
