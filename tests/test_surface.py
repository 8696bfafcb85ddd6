"""Analyzers, rewriting, judging and measures against plain expectations."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.analysis import ENGLISH, RAW, grounding_score, link_strength, parse
from tessella.functions.stem import stem
from tessella.operators import judging, measures, retrieval, rewrite
from tessella.sources import sections


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems():
    pairs = {
        "consign": "consign", "consisted": "consist", "consistency": "consist", "consolations": "consol", "conspicuously": "conspicu",
        "knackeries": "knackeri", "knightly": "knight", "knots": "knot", "generously": "generous", "skies": "sky", "dying": "die",
        "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this", "kiwis": "kiwi", "happily": "happili",
        "relational": "relat", "nationality": "nation", "inventor": "inventor", "inventions": "invent", "running": "run", "by": "by",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_fold_and_terms(spark):
    assert one(spark, T.fold(F.lit("Àâîôûùïëåøœãõšž ŁÆÞ ß Ω"))) == "AaiouuieaooeaosZ".replace("Z", "z") + " LAETH ss Ω"
    assert one(spark, T.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))) == 3.0
    assert one(spark, T.answer_sentences(F.lit("Pi is 3.14. So? yes\nno"))) == ["Pi is 3.14.", "So?", "yes", "no"]
    terms = F.array(*map(F.lit, ["the", "lamp", "of", "iron"]))
    assert one(spark, T.display_order(terms)) == ["lamp", "iron", "the", "of"]
    assert one(spark, T.term_list(terms, 2)) == '"the", "lamp", and 2 more'
    assert one(spark, T.term_list(F.array().cast("array<string>"), 2)) == "(none)"


def test_analyzers(spark):
    assert one(spark, ENGLISH.tokens(F.lit("The parseHTTP inventors were running"))) == ["parsehttp", "pars", "http", "inventor", "run"]
    assert parse("char_ngram:2-3").name == "char_ngram_2_3" and parse("raw") is RAW
    for bad in ("char_ngram:0-2", "klingon"):
        with pytest.raises(ValueError):
            parse(bad)
    assert one(spark, grounding_score(F.lit("inventions of lamps"), F.lit("the inventor invents a lamp"))) == 1.0
    assert one(spark, link_strength(F.lit("the of"), F.lit("lamp"))) == 0.0


def test_rewriting(spark):
    q = spark.createDataFrame([(0, "Highlight the parts, related to Governing Law"), (1, "office hours")], "query_id long, query string")
    s = rewrite.Stripper(("highlight", "part", "related"))
    got = {r["query_id"]: r["r"]["text"] for r in s.table(q, "query", "r").collect()}
    assert got == {0: "the to Governing Law", 1: "office hours"}
    effect = rewrite.Stripper(("off", "hour"), RAW).effect(q).where("query_id = 1").first()
    assert effect["stripped"] == "office hours" and effect["probable_silent_no_op"] == ["off", "hour"]
    v = rewrite.Vocabulary((("governing law", "jurisdiction", "choice of law"),))
    out = rewrite.chain(q, [rewrite.Stripper(("highlight",), RAW), v]).orderBy("query_id").collect()
    assert out[0]["query"].endswith("Governing Law jurisdiction choice of law") and [t["stage"] for t in out[0]["rewrites"]] == ["strip", "expand"]
    assert out[1]["query"] == "office hours"
    both = rewrite.Vocabulary((("governing law", "jurisdiction"),), True)
    assert one(spark, both.column(F.lit("the Jurisdiction"))["text"]) == "the Jurisdiction governing law"


def test_judges(spark):
    assert judging.parse_claims("1. one\n- two\n\n* three\n12. four") == ["one", "two", "three", "12. four"]
    scores = judging.parse_batched_scores("1: 0.9\n2: yes\n9: 1\nx", 3)
    assert scores[:2] == [0.9, 1.0] and math.isnan(scores[2])
    assert judging.parse_classification("A1: TP\na2: fp\nFN: R2\nFN: R9", 2, 2) == (1, 1, 1)
    rows = spark.createDataFrame([("q", "an answer", "the context", "gold"), ("q", "bad", "the context", None)], "query string, answer string, context string, gold_answer string")

    def judge(prompt, system):
        if "bad" in prompt:
            raise RuntimeError("no")
        if system == judging.CLAIMS:
            return {"raw_text": "1. first\n2. second", "score": None}
        if system == judging.VERIFY:
            return "1: 1.0\n2: 0.2"
        if system == judging.COMPARE:
            return "A1: TP\nA2: FP\nFN: R2"
        return 0.75

    got = {r["answer"]: r for r in judging.decomposed_faithfulness(rows, judge).collect()}
    assert abs(got["an answer"]["faithfulness_judged"] - 0.6) < 1e-9 and got["an answer"]["n_supported"] == 1 and got["bad"]["faithfulness_judged"] is None
    got = {r["answer"]: r["correctness_judged"] for r in judging.decomposed_correctness(rows, judge).collect()}
    assert abs(got["an answer"] - 0.5) < 1e-9 and got["bad"] is None
    aspects = [judging.Aspect("clear", "Is it clear?"), judging.Aspect("harm", "Is it harmful?", False)]
    got = {(r["answer"], r["aspect"]): r["score"] for r in judging.critique(rows, aspects, judge, context="context").collect()}
    assert got == {("an answer", "clear"): 0.75, ("an answer", "harm"): 0.25, ("bad", "clear"): None, ("bad", "harm"): None}
    assert {r["relevancy_judged"] for r in judging.single(rows, judge, "relevancy").collect()} == {0.75, None}
    kept = judging.CachedJudge(lambda p, s: 1)
    assert [kept("a"), kept("a"), kept("b")] == [1, 1, 1] and (kept.hits, kept.misses) == (1, 2)


def test_measures(spark):
    rows = spark.createDataFrame([(1, 0.5, None, False), (2, 1.0, 1.0, True)], "id long, context_recall double, context_precision double, low boolean")
    got = [r["o"] for r in rows.select("id", measures.overall(rows.columns, F.col("low")).alias("o")).orderBy("id").collect()]
    assert got[0] == 0.5 and abs(got[1] - 0.2) < 1e-9
    ci = measures.bootstrap(spark.createDataFrame([("a", i, float(i)) for i in range(40)], "g string, i long, x double"), ["g"], "x", "i").first()
    assert ci["mean"] == 19.5 and 12 < ci["low"] < 19.5 < ci["high"] < 27
    chunks = spark.createDataFrame([("a", 'The "Territory" means the whole of France. plain words here')], "chunk_id string, chunk_text string")
    assert [tuple(r) for r in measures.definitions(chunks).collect()] == [("Territory", "the whole of France")]
    assert sorted(r["chunk_id"] for r in measures.repeated(chunks, 3).collect()) == ["a", "a#1", "a#2"]
    worse = measures.misread(chunks, 1.0).first()["chunk_text"]
    assert worse.replace(" ", "") == chunks.first()["chunk_text"].replace(" ", "") and worse != chunks.first()["chunk_text"]


def test_phrases_of_any_length(spark):
    c = spark.createDataFrame([("x", "a b c a b"), ("y", "b a c")], "chunk_id string, chunk_text string")
    q = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "c"), (4, "a a")], "query_id long, query string")
    assert sorted(map(tuple, retrieval.phrase(c, q).collect())) == [(1, "x", 2), (2, "x", 1), (3, "x", 1), (3, "y", 1)]


def test_code_blocks(spark):
    code = "import os\n\npub async fn run(x) {\n  y\n\n  z\n}\nclass Foo:\n  pass\n"
    rows = sections.code_blocks(spark.createDataFrame([("a.rs", code)], "source string, text string"), "source", "text").orderBy("line").collect()
    assert [(r["line"], r["heading"]) for r in rows] == [(1, None), (3, "pub async fn run(x)"), (6, "pub async fn run(x)")]
