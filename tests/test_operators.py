from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking, context, retrieval, workload
from tessella.operators.context import ContextConfig
from tessella.sources import files, sections
from tessella.sources.incremental import upsert
from tessella.streaming.audit import audit
from tessella.streaming.index import follow


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def packed(texts, target, most, overlap):
    """Sentence packing, step by step."""
    out, held = [], []
    n = lambda xs: sum(len(x.split()) for x in xs)
    for s in texts:
        if held and n(held) + len(s.split()) > target:
            out.append(" ".join(held))
            held = held[len(held) - overlap :] if overlap and len(held) > overlap else []
        if len(s.split()) > most:
            out.append(" ".join([*held, s]))
            held = [s] if overlap else []
            continue
        held = [*held, s]
        if n(held) >= most:
            out.append(" ".join(held))
            held = held[len(held) - overlap :] if overlap and len(held) > overlap else []
    return out + ([" ".join(held)] if held else [])


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Straße, ÉTÉ-2 don't"))) == ["strasse", "ete", "2", "don", "t"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.sanitize(F.lit('a+(B)  "c"'))) == "a b c"
    assert one(spark, T.char_ngrams(F.lit("ab"), 3, 4)) == [" ab", "ab ", " ab "]
    assert one(spark, T.char_ngrams(F.lit("--"), 3, 4)) == []
    assert one(spark, T.camel_pieces(F.lit("parseHTTPResponse2xx"))) == ["parse", "HTTP", "Response", "2", "xx"]


def test_fixed_chunks_are_slices(spark):
    text = "  one, two (three) four. five six  "
    rows = chunking.fixed(spark.createDataFrame([(1, text), (2, " ... "), (3, None)], "doc_id long, text string"), 3, 1).orderBy("piece").collect()
    assert [r["chunk_text"] for r in rows] == ["one, two (three", "three) four. five", "five six"]
    assert all(r["chunk_text"] in text for r in rows)
    with pytest.raises(ValueError):
        chunking.fixed(spark.createDataFrame([], "doc_id long, text string"), 3, 3)


@pytest.mark.parametrize(("target", "most", "overlap"), [(6, 9, 1), (4, 4, 0), (3, 12, 2)])
def test_sentence_chunks(spark, target, most, overlap):
    text = "a b c. d e. f g h i j k l m n o. p! q r s? t u v w x y z.\nlast one"
    got = chunking.sentence(spark.createDataFrame([(1, text)], "doc_id long, text string"), target, most, overlap).orderBy("piece").collect()
    sents = [s["x"] for s in [spark.range(1).select(T.sentences(F.lit(text)).alias("x")).first()]][0]
    assert [r["chunk_text"] for r in got] == packed(sents, target, most, overlap)


def candidates(spark, sizes):
    q = spark.createDataFrame([(0, "safety lamp inventor nationality")], "query_id long, query string")
    texts = ["the safety lamp inventor", "inventor humphry was cornish", "cornish pasties and tin", "stock markets rose", "the safety lamp inventor"]
    rows = [(str(i), t, n) for i, (t, n) in enumerate(zip(texts, sizes, strict=True))]
    c = spark.createDataFrame(rows, "chunk_id string, chunk_text string, token_count int")
    found = spark.createDataFrame([(0, i + 1, str(i), 1.0 - i / 10) for i in range(5)], "query_id long, rank int, chunk_id string, score double")
    return found, c, q


def selected(spark, strategy, budget=100, sizes=(4, 4, 4, 4, 4), **more):
    cfg = ContextConfig(strategy=strategy, budget=budget, min_grounding=0.25, **more)
    return context.assemble(context.characterize(*candidates(spark, sizes), cfg), cfg).first()


def test_strategies(spark):
    assert selected(spark, "raw_topk")["selected"] == ["0", "1", "2", "3", "4"]
    assert selected(spark, "distractor_filtered")["selected"] == ["0", "1", "4"]
    assert selected(spark, "redundancy_pruned")["selected"] == ["0", "1", "2", "3"]
    kept = selected(spark, "reasoning_preserving")
    assert kept["selected"] == ["0", "4", "1", "2"] and kept["n_rescued"] == 1
    assert selected(spark, "raw_topk", 9, (4, 6, 4, 4, 4))["selected"] == ["0", "2"]  # skips what doesn't fit
    with pytest.raises(ValueError):
        ContextConfig(strategy="best")


@pytest.mark.parametrize(("total", "want"), [(1499, "raw_topk"), (1500, "raw_topk"), (1501, "reasoning_preserving")])
def test_auto_gate(spark, total, want):
    assert selected(spark, "auto", 10_000, (total - 4, 1, 1, 1, 1))["strategy"] == want


def test_fusion_and_top_up(spark):
    a = spark.createDataFrame([(0, 1, "x", 2.0), (0, 2, "y", 1.0)], "query_id long, rank int, chunk_id string, score double")
    b = spark.createDataFrame([(0, 1, "y", 5.0), (0, 2, "z", 5.0)], "query_id long, rank int, chunk_id string, score double")
    assert [r["chunk_id"] for r in retrieval.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    got = {r["chunk_id"]: r["score"] for r in retrieval.weighted_fusion([(a, 1.0), (b, 0.5)]).collect()}
    assert got == {"x": 1.0, "y": 0.5, "z": 0.5}
    assert [(r["chunk_id"], r["added"]) for r in retrieval.top_up(a, b, 3).orderBy("rank").collect()] == [("x", False), ("y", False), ("z", True)]


def test_scores_of_judges(spark):
    rows = ["yes", "No, never", "85%", "0.4", "7", "-2", "none", "true"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(workload.parse_score(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == [1.0, 0.0, 0.85, 0.4, 0.07, 0.0, 0.0, 1.0]


def test_sections(spark):
    text = "intro\n# One #\nbody\n\n## Two\nmore"
    rows = sections.markdown(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("section_idx").collect()
    assert [(r["heading"], r["line"]) for r in rows] == [(None, 1), ("One", 2), ("Two", 5)]
    kinds = spark.createDataFrame([("a.py",), ("b.JSON",), ("c.md",), ("d",)], "s string").select(sections.kind(F.col("s")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["code", "data", "prose", "prose"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "empty.md").write_text(" ")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "p.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<s xmlns:a="u"><a:t>slide</a:t><a:t>{n}</a:t></s>')
    rows = files.read_folder(spark, str(tmp_path)).collect()
    good = {(r["source"].rpartition("/")[2], r["text"], r["page"]) for r in rows if r["error"] is None}
    assert good == {("a.txt", "plain", None), ("p.pptx", "slide 2", 2), ("p.pptx", "slide 10", 10)}
    assert {r["source"].rpartition("/")[2] for r in rows if r["error"]} == {"b.bin", "empty.md", "bad.docx"}


def test_upsert(spark):
    schema = "source string, stamp string"
    got = upsert(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], schema))
    assert {(r["source"], r["action"]) for r in got.collect()} == {("a", "reuse"), ("b", "replace"), ("c", "drop"), ("d", "add")}


def test_streams(spark, smallest, tmp_path):
    events = spark.read.parquet(f"{smallest}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{smallest}/events*.parquet")
    run = audit(stream, late="1000 days").writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(spark.table("audit")) == key(audit(events))
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_bm25_gives_the_same_rows_by_blocks_and_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "red fish blue fish" if i % 3 else f"red {i} cat", "a b") for i in range(40)] + [(99, None, "b")], "chunk_id long, chunk_text string, h string")
    q = spark.createDataFrame([("x", "red fish fish"), ("y", "cat 7 b"), ("z", ""), ("w", None)], "query_id string, query string")
    args = dict(k=5, fields={"text": "chunk_text", "h": "h"}, weights={"h": 2.0}, repeat_terms=True)
    monkeypatch.setattr(retrieval, "CELLS", 7)
    blocks = sorted(map(tuple, retrieval.bm25(docs, q, **args).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert blocks == sorted(map(tuple, retrieval.bm25(docs, q, **args).collect())) and len(blocks) == 10
    assert retrieval.bm25(docs.limit(0), q).count() == 0 and retrieval.bm25(docs, q.limit(0)).count() == 0


def test_dense_in_blocks_with_ties_nulls_and_odd_lengths(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 4), 0.0]) for i in range(30)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0]), (93, [1.0, None, 2.0, 5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0]), (3, None)], "query_id long, vector array<float>")

    def plain(a, b):
        a, b = [x or 0.0 for x in a], [x or 0.0 for x in b]
        norm = lambda x: sum(y * y for y in x) ** 0.5 or 1.0
        return round(sum(x * y for x, y in zip(a, b, strict=False)) / norm(a) / norm(b), 6)

    want = []
    for i, x in ((1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0])):
        best = sorted((-plain(x, e), k) for k, e in rows if e is not None)[:9]
        want += [(i, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    for size in (retrieval.BROADCAST_BYTES, 40):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        assert sorted(map(tuple, retrieval.dense(v, q, 9).collect())) == want


def test_best_cuts_to_k_rows_of_each_query(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessella.operators import best

    monkeypatch.setattr(best, "HELD", 20)
    rng, got, rows = np.random.default_rng(1), best.Best(3, 4, pa.int64()), []
    for i in range(30):
        scores, found = rng.integers(0, 5, (6, 3)) / 3, rng.random((6, 3)) < 0.7
        got.add(pa.array(range(6 * i, 6 * i + 6)), scores, found)
        rows += [(c, -round(scores[r, c], 6), 6 * i + r) for r in range(6) for c in range(3) if found[r, c]]
    want = [x for c in range(3) for x in sorted(r for r in rows if r[0] == c)[:4]]
    assert [(r["q"], -r["score"], r["key"]) for r in got.take().to_pylist()] == want
