"""Scores by a judge: a callable (prompt, system) -> number, text or dict, called on the executors.

Each distinct (prompt, system) is asked once and joined back; a call that fails gives null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[str, str | None], Any]

CRITIC = "Score one stated property of an answer. Reply with one number from 0 to 1 and nothing else."
CLAIMS = "List the separate factual claims of the given answer, one on each line, without comments."
VERIFY = "For each numbered claim say how well the context supports it: one line 'number: score' with a score from 0 to 1."
COMPARE = "Mark each claim of the answer (A1, A2, ...) as TP or FP against the reference, and each reference claim (R1, R2, ...) that the answer lacks as 'FN: R<number>', one on each line."
FAITHFUL = "Say from 0 to 1 how far the context supports the answer. Reply with the number only."
RELEVANT = "Say from 0 to 1 how directly the answer addresses the question. Reply with the number only."
CORRECT = "Say from 0 to 1 how far the answer agrees with the reference answer. Reply with the number only."


def parse_score(raw: Any) -> float:
    """0..1 from a judge's reply; raises ValueError where there is no number."""
    if isinstance(raw, dict):
        raw = raw["score"] if raw.get("score") is not None else raw.get("raw_text", "")
    if isinstance(raw, bool):
        return float(raw)
    if isinstance(raw, int | float):
        if math.isnan(raw):
            raise ValueError("not a number")
        return min(max(float(raw), 0.0), 1.0)
    s = str(raw).strip().lower()
    if s.startswith(("yes", "true")):
        return 1.0
    if s.startswith(("no", "false")):
        return 0.0
    m = re.search(r"-?\d+(?:\.\d+)?", s)
    if m is None:
        raise ValueError(f"no score in {raw!r}")
    n = float(m[0])
    if n < 0:
        return 0.0
    percent = s[m.end() :].lstrip().startswith("%")
    return min(n / 100, 1.0) if percent or n > 1 else n


def raw_text(reply: Any) -> str:
    return str(reply.get("raw_text", reply.get("score", ""))) if isinstance(reply, dict) else str(reply)


def parse_claims(text: str) -> list[str]:
    """Claims of a reply: one for each line, without a one-digit number or bullets."""
    lines = (re.sub(r"^\d[.)]\s*", "", x.strip()) for x in text.splitlines())
    return [c for c in (x.lstrip("-*").strip() for x in lines) if c]


def parse_batched_scores(text: str, n: int) -> list[float]:
    """Scores of claims 1..n from lines 'number: score'; not-a-number where a line is missing."""
    out = [math.nan] * n
    for line in text.splitlines():
        number, colon, score = line.strip().partition(":")
        digits = re.sub(r"^\D+|\D+$", "", number)
        if colon and digits.isdigit() and 1 <= int(digits) <= n:
            try:
                out[int(digits) - 1] = parse_score(score.strip())
            except ValueError:
                continue
    return out


def parse_classification(text: str, n_answer: int, n_gold: int) -> tuple[int, int, int]:
    """(true positives, false positives, misses) from lines 'A1: TP' and 'FN: R2'."""
    verdict: dict[int, bool] = {}
    missed: set[int] = set()
    for line in text.splitlines():
        tag, colon, said = (x.strip() for x in line.partition(":"))
        if not colon:
            continue
        if m := re.fullmatch(r"[Aa](\d+)", tag):
            if 1 <= int(m[1]) <= n_answer and ("TP" in said.upper() or "FP" in said.upper()):
                verdict[int(m[1])] = "TP" in said.upper()
        elif tag.upper() == "FN" and (m := re.fullmatch(r"[Rr]*(\d+)", said)) and 1 <= int(m[1]) <= n_gold:
            missed.add(int(m[1]))
    hits = sum(verdict.values())
    return hits, len(verdict) - hits, len(missed)


def f_beta(tp: int, fp: int, fn: int, beta: float = 1.0) -> float:
    b = beta * beta
    whole = (1 + b) * tp + b * fn + fp
    return (1 + b) * tp / whole if whole else 0.0


def asked(rows: DataFrame, judge: Judge, prompt: str = "prompt", system: str = "system", out: str = "reply") -> DataFrame:
    """``rows`` with the judge's reply as text and as ``<out>_score``; each distinct pair is asked once, failures give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores = [], []
            for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = score = None
                try:
                    reply = judge(p, s)
                    text = raw_text(reply)
                    score = parse_score(reply)
                except Exception:  # noqa: BLE001  a judge that fails on one prompt mustn't stop the others
                    pass
                texts.append(text)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["_p", "_s", out, f"{out}_score"])

    once = rows.select(F.col(prompt).alias("_p"), F.col(system).alias("_s")).where("_p is not null").distinct()
    got = once.mapInArrow(run, f"_p string, _s string, {out} string, {out}_score double")
    return rows.join(got, F.col(prompt).eqNullSafe(F.col("_p")) & F.col(system).eqNullSafe(F.col("_s")), "left").drop("_p", "_s")


class CachedJudge:
    """A judge that remembers its replies in one worker; failures aren't kept."""

    def __init__(self, judge: Judge, name: str = "judge"):
        self.judge, self.name, self.kept = judge, name, {}
        self.hits = self.misses = 0

    def __call__(self, prompt: str, system: str | None = None) -> Any:
        key = (self.name, prompt, system)
        if key in self.kept:
            self.hits += 1
        else:
            self.misses += 1
            self.kept[key] = self.judge(prompt, system)
        return self.kept[key]


@dataclass(frozen=True)
class Aspect:
    """A property to score; where high isn't good the score is turned round."""

    name: str
    definition: str
    high_is_good: bool = True


def prompt_of(*parts: tuple[str, Column]) -> Column:
    """Titled sections of a prompt; those that are null are left out."""
    return F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(t + ":\n"), c)) for t, c in parts])), "\n\n")


def critique(rows: DataFrame, aspects: list[Aspect], judge: Judge, answer: str = "answer", context: str | None = None, query: str | None = None) -> DataFrame:
    """``rows`` with one row and a ``score`` for each aspect; 1 is good whatever the aspect's sense; null where the judge failed."""
    if not aspects:
        return rows.limit(0).select("*", F.lit("").alias("aspect"), F.lit(None).cast("double").alias("score"))
    of = F.explode(F.array(*[F.struct(F.lit(a.name).alias("name"), F.lit(a.definition).alias("definition"), F.lit(a.high_is_good).alias("good")) for a in aspects]))
    none = F.lit(None).cast("string")
    each = rows.select("*", of.alias("_a"))
    prompt = prompt_of(
        ("QUESTION", F.col(query) if query else none), ("CONTEXT", F.col(context) if context else none), ("ANSWER", F.col(answer)), ("SCORE", F.col("_a.definition"))
    )
    got = asked(each.withColumn("prompt", prompt).withColumn("system", F.lit(CRITIC)), judge)
    score = F.when(F.col("_a.good"), F.col("reply_score")).otherwise(1 - F.col("reply_score"))
    return got.select(*rows.columns, F.col("_a.name").alias("aspect"), score.alias("score"))


def single(rows: DataFrame, judge: Judge, kind: str) -> DataFrame:
    """``rows`` (query, answer, context, gold_answer) with ``<kind>_judged``: one prompt for each row."""
    system, parts = {
        "faithfulness": (FAITHFUL, (("CONTEXT", "context"), ("ANSWER", "answer"))),
        "relevancy": (RELEVANT, (("QUESTION", "query"), ("ANSWER", "answer"))),
        "correctness": (CORRECT, (("REFERENCE", "gold_answer"), ("ANSWER", "answer"))),
    }[kind]
    whole = F.lit(True)
    for _, c in parts:
        whole = whole & F.col(c).isNotNull()
    prompt = F.when(whole, prompt_of(*[(t, F.col(c)) for t, c in parts]))
    got = asked(rows.withColumn("prompt", prompt).withColumn("system", F.lit(system)), judge)
    return got.withColumnRenamed("reply_score", f"{kind}_judged").drop("prompt", "system", "reply")


def claims_of(rows: DataFrame, judge: Judge, column: str, out: str) -> DataFrame:
    split = F.udf(lambda t: parse_claims(t) if t else [], "array<string>")
    got = asked(rows.withColumn("_q", F.when(F.col(column).isNotNull(), prompt_of(("ANSWER", F.col(column))))).withColumn("_y", F.lit(CLAIMS)), judge, "_q", "_y", "_c")
    return got.withColumn(out, split("_c")).drop("_q", "_y", "_c", "_c_score")


def numbered(claims: Column, letter: str = "") -> Column:
    return F.array_join(F.transform(claims, lambda c, i: F.concat(F.lit(letter), (i + 1).cast("string"), F.lit(". "), c)), "\n")


def decomposed_faithfulness(rows: DataFrame, judge: Judge) -> DataFrame:
    """``rows`` (answer, context) with the mean support of the answer's claims, their number and how many have at least half.

    Null where there is no claim or the judge fails; a claim that the judge passes over has no support.
    """
    score = F.udf(lambda t, n: None if t is None else [0.0 if math.isnan(x) else x for x in parse_batched_scores(t, n)], "array<double>")
    got = claims_of(rows, judge, "answer", "_claims")
    ask = F.when(F.size("_claims") > 0, prompt_of(("CONTEXT", F.col("context")), ("CLAIMS", numbered(F.col("_claims")))))
    got = asked(got.withColumn("_q", ask).withColumn("_y", F.lit(VERIFY)), judge, "_q", "_y", "_v")
    got = got.withColumn("_s", score("_v", F.size("_claims")))
    mean = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.size("_s")
    out = got.withColumn("faithfulness_judged", F.when(F.size("_s") > 0, mean)).withColumn("n_claims", F.size("_claims"))
    return out.withColumn("n_supported", F.size(F.filter("_s", lambda x: x >= 0.5))).drop("_claims", "_q", "_y", "_v", "_v_score", "_s")


def decomposed_correctness(rows: DataFrame, judge: Judge, beta: float = 1.0) -> DataFrame:
    """``rows`` (answer, gold_answer) with the F-score of the answer's claims against the reference's."""
    measure = F.udf(lambda t, a, g: None if t is None else f_beta(*parse_classification(t, a, g), beta), "double")
    got = claims_of(claims_of(rows, judge, "answer", "_a"), judge, "gold_answer", "_g")
    ask = F.when((F.size("_a") > 0) & (F.size("_g") > 0), prompt_of(("ANSWER CLAIMS", numbered(F.col("_a"), "A")), ("REFERENCE CLAIMS", numbered(F.col("_g"), "R"))))
    got = asked(got.withColumn("_q", ask).withColumn("_y", F.lit(COMPARE)), judge, "_q", "_y", "_v")
    return got.withColumn("correctness_judged", measure("_v", F.size("_a"), F.size("_g"))).drop("_a", "_g", "_q", "_y", "_v", "_v_score")
