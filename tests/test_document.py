"""The document surface, sections, chunks of sections, expansion and vectors against plain expectations."""

from __future__ import annotations

import pytest

from tessella.document import Document, Options
from tessella.operators import chunking, context, expansion, rewrite
from tessella.operators.context import ContextConfig
from tessella.sources import sections

CODE = "def alpha(x):\n    return lamp\n\nclass Beta:\n    pass\n"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source string, text string")


def test_markdown_sections(spark):
    text = "---\ntitle: x\n---\nintro\n\nBig\n===\nbody\n---\nmore\n## Small ##\nend\n---\n---\n"
    rows = sections.markdown_sections(docs(spark, text, "one\ntwo\n\nthree", None, "---\nopen", ""), "source", "text").orderBy("source", "section_idx").collect()
    got = [(r["source"], r["heading"], r["line"], r["section"]) for r in rows]
    assert got == [
        ("d0", None, 4, "intro"),
        ("d0", "Big", 6, "Big"),
        ("d0", "body", 8, "body\nmore"),
        ("d0", "Small", 11, "## Small ##"),
        ("d0", "end", 12, "end\n---"),
        ("d1", None, 1, "one\ntwo"),
        ("d1", None, 4, "three"),
        ("d3", None, 1, "---\nopen"),
    ]


def test_chunks_of_sections(spark):
    rows = spark.createDataFrame(
        [("a.md", 0, "One lamp. Two lamps.", "Lamps"), ("a.md", 1, " ", None), ("b.py", 0, CODE, None), ("c.md", 0, None, None)],
        "source string, section_idx long, text string, heading string",
    )
    got = {r["chunk_id"]: r for r in chunking.by_sections(rows).collect()}
    assert set(got) == {"a.md:0:0", "b.py:0:0"}
    assert got["a.md:0:0"]["heading"] == "Lamps" and got["a.md:0:0"]["kind"] == "prose" and got["a.md:0:0"]["token_count"] == 4
    assert got["b.py:0:0"]["kind"] == "code" and "    return lamp" in got["b.py:0:0"]["chunk_text"] and got["b.py:0:0"]["page"] is None
    assert chunking.by_sections(rows.limit(0)).count() == 0


def chunk_table(spark):
    rows = [("s", i, f"c{i}", "h" if i < 3 else "g", 10) for i in range(6)]
    return spark.createDataFrame(rows, "source string, chunk_index int, chunk_id string, heading string, token_count int")


def test_expansion_fits_the_budget(spark):
    chunks = chunk_table(spark)
    before = spark.createDataFrame([(1, ["c4", "c2"], 20, 2), (2, ["c0"], 10, 1)], "query_id long, selected array<string>, total_tokens long, n_selected long")
    place = {"source": "source", "at": "chunk_index"}
    more = expansion.plan(before, chunks, 1, True, **place)
    plan = {(r["query_id"], r["seed"], r["companion"], r["step"]) for r in more.collect()}
    assert plan == {(1, "c4", "c3", 0), (1, "c4", "c5", 1), (1, "c4", "c3", 2), (1, "c2", "c1", 0), (1, "c2", "c3", 1), (1, "c2", "c0", 2), (2, "c0", "c1", 1)}
    got = {r["query_id"]: (r["selected"], r["total_tokens"], r["n_selected"], r["n_expanded"]) for r in expansion.expanded(before, more, chunks, 45, **place).collect()}
    assert got == {1: (["c2", "c3", "c4", "c5"], 40, 4, 2), 2: (["c0", "c1"], 20, 2, 1)}
    got = {r["query_id"]: (r["selected"], r["n_expanded"]) for r in expansion.expanded(before, more, chunks, 15, **place).collect()}
    assert got == {1: (["c4", "c2"], 0), 2: (["c0"], 0)}
    assert expansion.plan(before, chunks, 0, False, **place).count() == 0


def test_vectors_tell_repeats(spark):
    rows = [(1, 1, "a", [1.0, 0.0], ["x"]), (1, 2, "b", [1.0, 0.1], ["y"]), (1, 3, "c", None, ["x"]), (1, 4, "d", [0.0, 1.0], ["x"])]
    items = spark.createDataFrame([(q, r, k, v, t, 5, 1.0, 1.0, False) for q, r, k, v, t in rows], "query_id long, rank int, chunk_id string, embedding array<double>, terms array<string>, token_count int, grounding double, density double, is_distractor boolean")
    cfg = ContextConfig(strategy="redundancy_pruned")
    # b repeats a by vector, c repeats a by terms, d differs from a by vector
    assert context.assemble(items, cfg).first()["selected"] == ["a", "d"]
    assert context.assemble(items.drop("embedding"), cfg).first()["selected"] == ["a", "b"]
    got = context.spread_of_vectors(items, 40).first()
    assert got["utilisation"] == 0.5 and abs(got["mean_cosine"] - (0.99504 + 0.0 + 0.0995) / 3) < 1e-4


def test_document(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n\ndef lamp_of(x):\n    return x\n\nclass Other:\n    pass\n")
    (tmp_path / "b.txt").write_text("The iron lamp burns. A river runs.\n")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    d = Document.from_folder(spark, str(tmp_path))
    assert d.n_sources() == 2 and [r["source"].rsplit("/", 1)[1] for r in d.skipped.collect()] == ["c.docx"]
    got = d.context(["iron lamp", "zebra"], budget=100).collect()
    assert [r["query_id"] for r in got] == [0] and got[0]["total_tokens"] <= 100
    cited = d.citations(d.context("iron lamp", 100)).collect()
    assert any(r["source"].endswith("b.txt") for r in cited)
    assert {r["query_id"]: r["hints"] for r in d.diagnose(["iron lamp", "zebra"]).collect()}[1] == "empty_context"
    assert d.analyze("iron lamp").first()["decision"] == "passthrough"


def test_document_of_texts(spark):
    d = Document.from_texts(spark, ["governing law of France", "", "jurisdiction clause"], Options(config=ContextConfig(strategy="raw_topk")))
    assert d.n_chunks() == 3
    told = d.context_with_rewrites("governing law", [rewrite.Vocabulary((("governing law", "jurisdiction"),))]).first()
    assert set(told["selected"]) == {"chunk-0", "chunk-2"} and told["rewrites"][0]["stage"] == "expand"
    assert "governing law of France" in d.texts(d.context("law")).first()["context"]
    assert Document.from_text(spark, "").n_chunks() == 0
    for bad in (lambda: Document.from_texts(spark, []), lambda: Document(spark.range(1)), lambda: Document(d.chunks, Options(weights={"title": 1.0}))):
        with pytest.raises(ValueError):
            bad()
    assert Options().fingerprint() == Options(k=5).fingerprint() != Options(target=64).fingerprint()
