"""Operators against plain versions, and on nulls, empties, ties, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, common, langid, neardup, packing, pii, quality, queries, rules, scoring, topk, toxicity
from tessella.llm.hashing import SortedHash, shingles_of, words_of

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "no id at all"), (None, None),
    (6, "x" * 70_000), (7, "one two three four five " * 4000), (8, "é 🙂 日本 \x00 \x1c z"), (9, "<|endoftext|> 's DON'T  a \n b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, 9) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, score int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, smallest):
    return spark.read.parquet(f"{smallest}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def labels_of(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_bpe(spark, odd, nothing, texts):
    lib = Tokenizer.from_file(BYTE)
    rows = ODD + texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"], r["n_tokens"]) for r in bpe.encode_decode(df, BYTE).collect())
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want)
    assert bpe.encode_decode(odd, BYTE).count() == len(ODD)
    assert bpe.encode_decode(nothing, BYTE).count() == 0


def test_bpe_spaces():
    lib, own = Tokenizer.from_file(BYTE), bpe.load(BYTE)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("ab1.' \n\t 　é") for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_trim_gives_back_what_a_task_freed():
    def resident() -> int:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    held = [bytes(1000) for _ in range(200_000)]
    held = held[::1000]  # what stays keeps the rest from going back by itself
    full = resident()
    common.trim()
    assert held and full - resident() > 100e6


def test_packing_words_are_shared_by_spellings():
    """One cached word for all cases and signs around it; any text gives the library's ids."""
    words = packing.WordTokenizer(WORD)
    words.batch(["Über über, (ÜBER) über%%% \u201cÜber\u201d über."], None)
    assert {w for w in words.cache.young if len(w) > 2} == {"über", "%%%", "\u201cÜber\u201d"}
    pick = random.Random(8)
    some = [chr(i) for i in range(256)] + ["'s", "'re", "'", "\u0301", "\u0130", "\u03a3", "\u65e5", "\u0663", "\u2003", "<|startoftext|>", "<|"]
    texts = some + ["".join(pick.choices(some + list("aBé'stremvld ."), k=12)) for _ in range(3000)] + ["", "x'S!'s"]
    lib = Tokenizer.from_file(WORD)
    for divides in (words.divides, False):
        words.divides = divides
        words.cache = common.TwoGenerations(500)
        assert words.batch(texts, None) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(spark, odd, docs, nothing, which):
    df = odd if which == "odd" else docs
    lib = Tokenizer.from_file(WORD)
    want = Counter()
    for r in df.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    rows = packing.pack_documents(df, WORD).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"] > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # a power of two takes no padding
    groups = defaultdict(dict)
    for r in rows:
        groups[r["step_group"]][r["sequence_id"]] = r["tier"]
    sums = Counter((g >> 38, sum(s.values()) == packing.STEP_TOKENS) for g, s in groups.items())
    assert all(sum(s.values()) <= packing.STEP_TOKENS for s in groups.values()) and all(n <= 1 for (_, full), n in sums.items() if not full)
    whole = Counter()
    for (doc, total), p in pieces.items():
        copies = sum(r["length"] for r in p) // total
        by = defaultdict(list)
        for r in p:
            by[r["start"]].append(r)
        assert sum(r["length"] for r in p) == copies * total
        if copies == 1:
            raw = b"".join(bytes(r["ids"]) for r in sorted(p, key=lambda r: r["start"]))
            whole[doc, zlib.crc32(raw)] += 1
    assert not whole - want
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_rules_sql(spark, smallest, odd, nothing):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{smallest}/documents.parquet'")
    df = queries.op3_quality_rules(spark, smallest)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({rules.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    got = rules.apply_rules(odd).where("not kept").count()  # a filter above mustn't change the plan's cost
    assert got == len(ODD)
    assert rules.filter_documents(nothing).columns == nothing.columns and rules.apply_rules(nothing).count() == 0


def test_pii(spark, odd, nothing):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aB1.2@+-( )_%é4.3 ") for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(2000 + i, "".join(rng.choice("1234567890 -.+@a") for _ in range(rng.randint(0, 80)))) for i in range(1500)]
    rows += [(i, t) for i, t in ODD if i] + [(5000, "a@b.com_x@y.org 1.2.3.4.5.6.7.8 x 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32 +1 (555) 123-4567")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    got = Counter(tuple(r) for r in pii.scan(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest).collect())
    assert got == Counter((i, *brute.pii_row(t)) for i, t in rows)
    assert pii.redact(df.where("doc_id = 5000")).first()["text"] == "[EMAIL][EMAIL] [IP].[IP] x [CARD] [IBAN] [PHONE]"
    assert pii.redact(odd).count() == len(ODD) and pii.redact(nothing).columns == nothing.columns
    rows = [(i, "".join(rng.choice(["a@b.cd", " 1.2.3.4", "é🙂 x", "+1 555 123 4567 ", "4111 1111 1111 1111", "\n"]) for _ in range(400 * i))) for i in range(6)]
    rows.append((9, "x" * 9000 + " a@b.cd " + "🙂" * 5000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        t, want, at = r["text"], "", 0
        for s in r["pii_spans"]:
            if s["start"] >= at:
                want += t[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert pii.redact(df.where(F.col("doc_id") == r["doc_id"])).first()["text"] == want + t[at:]


def test_context_words_decide(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'token = "{key}"'), (2, f"commit {key}"), (3, f'example token = "{key}"'), (4, "social security 123-45-6789"), (5, "part 123-45-6789"), (6, "mac 00:1A:2b:3c:4d:5e")]
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "secret:9:49", 2: "", 3: "", 4: "ssn:16:27", 5: "", 6: "mac:4:21"}


def test_iban_before_words_and_numbers(spark):
    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    after = ["", " Bitte", " The next", " 2024", " BIC COBADEFF", "."]
    rows = [(i * 10 + j, f"IBAN {x}{y}") for i, x in enumerate(ibans) for j, y in enumerate(after)]
    rows += [(100, "IBAN DE89370400440532013001 Bitte"), (101, "IBAN DE8937040044053201300 2024"), (102, "IBAN DE893704004405320130007")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(df).collect()}
    assert got == {i: f"iban:5:{5 + len(ibans[i // 10])}" if i < 100 else "" for i, _ in rows}
    assert pii.redact(df.where("doc_id = 1")).first()["text"] == "IBAN [IBAN] Bitte"


def test_pii_stays_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "a@" + "b." * 100_000, "+1" + "-" * 200_000, "1.2." * 100_000]
    assert pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    many = spark.createDataFrame([(1, "a@b.cd, " * 80_000)], "doc_id long, text string")
    began = time.time()
    assert pii.scan(many).first()["n_email"] == 80_000
    assert pii.redact(many).first()["text"] == "[EMAIL], " * 80_000
    assert time.time() - began < 60


def test_near_duplicates(spark, docs, texts, nothing):
    for k in (4, 5):
        got = sorted(map(tuple, neardup.classes(docs, k).collect()))
        assert got == sorted(brute.components(texts, k))
    assert neardup.classes(nothing).count() == 0
    with pytest.raises(ValueError):
        neardup.classes(docs, threshold=(7, 10))


def test_near_duplicates_odd(spark, odd):
    rows = [(1, "a b c d e"), (1, "x y z w v"), (2, "x y z w v"), (None, "A b\nc d e"), (5, None), (6, ""), (7, "a"), (8, "A"), (None, "q")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False), (None, None, True)]
    )
    assert neardup.classes(odd).count() == len(ODD)


@pytest.mark.parametrize(("group", "size"), [(4, 1 << 20), (1000, 3000)])
def test_near_duplicates_in_slices(spark, monkeypatch, group, size):
    """A chain of texts where each is close to the next ones only, and groups cut into small slices."""
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "GROUP_BYTES", size)
    monkeypatch.setattr(neardup, "REGION", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(40)] + [(100 + i, " ".join([*words[:90], f"z{i}"])) for i in range(30)]
    # a boilerplate of three quarters: signatures propose what the sets refuse
    rows += [(200 + i, " ".join([*(f"p{k}" for k in range(100)), *(f"q{i}-{k}" for k in range(14 + i % 4))])) for i in range(12)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows, 4))


def test_regions_ascend():
    """Deepest prefixes first; a pair is compared once, and not at all inside a component."""
    asked = []
    close = {(0, 1), (3, 4), (1, 3)}

    def similar(i, others):
        asked.extend((min(i, j), max(i, j)) for j in others.tolist())
        return np.array([(min(i, j), max(i, j)) in close for j in others])

    made = neardup.ascend(np.array([0, 8, 5, 4, 6]), similar)
    root = list(range(5))
    for i, j in made:
        root = [root[i] if r == root[j] else r for r in root]
    assert len(made) == 3 and len({root[i] for i in (0, 1, 3, 4)}) == 1 and root[2] not in root[:2]
    later = asked[4:]  # the first four ask whether one member is close to all
    assert later[0] == (0, 1) and later[1] == (3, 4) and len(later) == len(set(later))


def test_one_row_of_a_class_stays(spark, nothing):
    a, b, c = "a b c d e f", "x y z w v u", "k l m n o p"
    rows = [(2, a, "s"), (5, a, "s"), (5, b, "t"), (9, c, "s"), (9, c, "s"), (None, c, "s"), (None, "n o i d s x", "s"), (None, "n o i d s x", "s"), (7, None, "s"), (8, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3).checkpoint()
    got = Counter(tuple(r) for r in neardup.filter_documents(df).collect())
    assert got == Counter([rows[0], rows[2], rows[3], rows[6], rows[8], rows[9]])
    assert neardup.filter_documents(nothing).count() == 0 and neardup.filter_documents(nothing).columns == nothing.columns


def test_shingles():
    rows = ["", "a", "a b", "A B c d e", "a b c d a b c d", "x" * 600_000 + " y z"]
    assert [len(s) for s in shingles_of([r.encode() for r in rows], 4)] == [len(brute.shingles(r, 4)) for r in rows]
    h, doc = words_of([b"ab c", b"", b"c"])
    assert doc.tolist() == [0, 0, 2] and h[1] == h[2] != h[0]
    t = SortedHash(np.arange(0, 3000, 3, dtype=np.uint64))
    assert ((t.find(np.arange(3000, dtype=np.uint64)) >= 0) == (np.arange(3000) % 3 == 0)).all()


def ppm(train, order):
    n = defaultdict(Counter)
    for t in train:
        b = b"\xff" * order + t + b"\xff"
        for i in range(order, len(b)):
            for j in range(order + 1):
                n[b[i - j : i]][b[i]] += 1

    def p(ctx, s):
        out, seen = 0.0, set()
        for j in range(order, -1, -1):
            c = n.get(ctx[order - j :])
            if c is None:
                continue
            total, kinds = sum(v for k, v in c.items() if k not in seen), sum(k not in seen for k in c)
            if s in c:
                return out + np.log10(c[s] / (total + kinds))
            if kinds:
                out += np.log10(kinds / (total + kinds))
            seen = set(c)
        return out + np.log10(1 / max(256 - len(seen), 1))

    def score(t):
        b = b"\xff" * order + t + b"\xff"
        return sum(p(b[i - order : i], b[i]) for i in range(order, len(b)))

    return score


@pytest.mark.parametrize("nodes", [10**6, 20_000])
def test_lm(spark, docs, texts, nodes, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 100_000)
    got = {r["doc_id"]: r for r in scoring.score_documents(docs, order=4, nodes=nodes).collect()}
    base = brute.unigram(texts)
    for i, (n, known, total, score) in base.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - score) < 1e-6 * abs(score)
        assert r["held_out"] == (brute.crc_mod(i, 7) == 2)
    train = [t.encode() for i, t in texts if brute.crc_mod(i, 7) != 2]
    order = 4
    while order > 1 and len({(b"\xff" * order + t + b"\xff")[i : i + order + 1] for t in train for i in range(len(t) + 1)}) > nodes:
        order -= 1
    model = ppm(train, order)
    for i, t in texts[:25]:
        assert abs(model(t.encode()) - got[i]["score"]) < 1e-6


def test_lm_order_is_fixed(spark):
    """More than three million grams of order 5; and no document to learn from."""
    rng = np.random.default_rng(3)
    rows = [(i, bytes(rng.integers(97, 123, 100_000, dtype=np.uint8)).decode()) for i in range(45)]
    train = [t.encode() for i, t in rows if brute.crc_mod(i, 7) != 2]
    keys, counts = scoring.gram_counts(train, 5)
    assert len(keys) > 3_000_000
    whole = scoring.Trie(keys, counts, 5)
    got = {r["doc_id"]: r["score"] for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    out = [i for i, _ in rows if brute.crc_mod(i, 7) == 2]
    for i in [*out[:2], next(i for i, _ in rows if i not in out)]:
        assert abs(got[i] - whole.score([rows[i][1].encode()])[0]) < 1e-6 * abs(got[i])
    none = scoring.score_documents(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).first()
    assert none["held_out"] and abs(none["score"] - 4 * np.log10(1 / 256)) < 1e-9


def test_lm_odd(odd, nothing):
    rows = scoring.score_documents(odd).collect()
    assert len(rows) == len(ODD) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert scoring.score_documents(nothing).count() == 0


def test_language(docs, odd, nothing):
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right >= 0.95
    rows = langid.identify(odd, langid.train(docs)).collect()
    assert Counter(r["lang_pred"] == "und" for r in rows)[True] == sum(not any(c.isalpha() for c in t or "") for _, t in ODD)
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(nothing, none).count() == 0


def test_language_learns_from_all(spark, monkeypatch):
    held = []
    monkeypatch.setattr(langid.Models, "entropy", lambda self, t: held.extend(t) or (np.ones((len(t), 2)), np.full(len(t), 9), np.ones(len(t), bool)))
    langid.Models({g: [f"{g} {'abcdefgh'[i % 8]}" for i in range(6000)] for g in ("aa", "bb")})
    assert Counter(t[:2] for t in held) == {"aa": 1200, "bb": 1200}
    monkeypatch.undo()
    monkeypatch.setattr(langid, "PER_LANGUAGE", 1)
    rows = [(i, "ein Satz " * 9, "de") for i in range(20)] + [(100 + i, "a sentence " * 9, "en") for i in range(20)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]


def test_language_probabilities_sum_to_one():
    m = langid.Models({"a": ["abab abba ba"] * 3, "b": ["bcbc cbcb"] * 3})
    for context in ("ab ", "zzz", " a b"[:3]):
        head = np.array([ord(c) for c in context], np.uint64)
        keys = (head[0] << np.uint64(48) | head[1] << np.uint64(32) | head[2] << np.uint64(16)) + np.arange(65536, dtype=np.uint64)
        assert np.allclose(np.exp(m.log_rows(keys, 4).astype(float)).sum(0), 1, atol=1e-3)


def test_quality(spark, smallest, odd, nothing):
    d = smallest.replace("sf0.001", "sf0.01")
    got = queries.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out")
    assert got.where("quality = predicted").count() >= 0.9 * got.count()
    lab = labels_of(spark)
    for labels in (lab, lab.limit(0), lab.where("quality = 1")):
        rows = quality.score_documents(odd, quality.train(odd, labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.score_documents(nothing, quality.train(nothing, lab)).count() == 0


def test_toxicity(spark, smallest, odd, nothing):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, lab = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["vilex", "nasty", "rottenly", "rottening"])
        rows.append((i, " ".join(words)))
        lab.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    y, text = dict(lab), dict(rows)
    held = [r for r in got if r["held_out"]]
    assert len(held) == sum(brute.crc_mod(i, 5) == 0 for i, _ in rows)
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.97 * len(held)
    found = {text[r["doc_id"]][s["start"] : s["end"]] for r in held for s in r["spans"]}
    assert found and found <= {"vilex", "nasty", "rottenly", "rottening"}
    full = labels_of(spark)
    for labels in (full, full.limit(0), full.where("toxic = 0")):
        rows = toxicity.score_documents(odd, toxicity.train(odd, labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score_documents(nothing, toxicity.train(nothing, full)).count() == 0


def test_field_marginals_are_exact():
    """Runs of plain tokens as matrix powers against a sum over all labellings."""
    f = toxicity.Field({"bad": 4.0, "ugly": 1.5}, -1.0, np.array([[0.7, -0.4], [-0.2, 0.5]]))
    for words in (["x", "bad", "x", "x", "ugly"], ["bad"], ["x", "x", "bad", "bad", "x", "x"], ["ugly", "x"]):
        n, weights, hits = len(words), [], []
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            s = sum(t * (f.bias + f.emission(w)) for t, w in zip(y, words, strict=True)) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False))
            weights.append(np.exp(s))
            hits.append(y)
        want = np.array(weights) @ np.array(hits) / sum(weights)
        at, got = f.document(words)
        assert at.tolist() == list(range(n)) and np.allclose(want, got)


def test_spans_after_letters_that_grow(spark):
    """A letter whose lower case is longer doesn't move what follows; all toxic spots of a text are learned from."""
    f = toxicity.Field({"vilex": 14.0}, -4.0)
    got = toxicity.score_documents(spark.createDataFrame([(1, "İstanbul kötü vilex VILEX İ")], "doc_id long, text string"), f).first()
    assert [("İstanbul kötü vilex VILEX İ"[s["start"] : s["end"]]) for s in got["spans"]] == ["vilex", "VILEX"]


def kneser_ney(texts, order=langid.ORDER):
    """P(character | forerunners) by counting strings."""
    grams = Counter()
    for t in texts:
        s = [32] * (order - 1) + [int(c) for c in langid.characters(t)[0]]
        grams.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    tables = [grams]
    for n in range(order - 1, 0, -1):
        tables.insert(0, Counter(g[1:] for g in tables[0]) if n == order - 1 else Counter(g[1:] for g in {h[-n - 1 :] for h in grams}))

    def p(ctx, c, n=order):
        if n == 0:
            return 1 / 65536
        table = tables[n - 1]
        ctx = ctx[len(ctx) - (n - 1) :]
        own = {g: k for g, k in table.items() if g[:-1] == ctx}
        if not own:
            return p(ctx, c, n - 1)
        once, twice = sum(k == 1 for k in table.values()), sum(k == 2 for k in table.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        return max(own.get((*ctx, c), 0) - d, 0) / total + d * len(own) / total * p(ctx, c, n - 1)

    return p


def test_language_models_are_kneser_ney():
    samples = {"a": ["abab abba ba", "ab cab"], "b": ["bcbc cbcb \U00010400b", "bbc"]}
    m = langid.Models(samples)
    models = {g: kneser_ney(ts) for g, ts in samples.items()}
    for text in ("abc ab", "zz b", "\U00010400\U00010428"):
        chars = langid.characters(text)[0]
        s = [32] * (langid.ORDER - 1) + [int(c) for c in chars]
        got = m.entropy([text])[0][0]
        for j, g in enumerate(m.languages):
            want = -np.mean([np.log(models[g](tuple(s[i : i + langid.ORDER - 1]), s[i + langid.ORDER - 1])) for i in range(len(chars))])
            assert abs(want - got[j]) < 1e-4
    assert len(set(langid.characters("\U00010400\U00010A00")[0].tolist())) == 3  # other letters of other scripts


def test_quality_quantile_and_filter(spark, odd, nothing):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(2, 1, (100, 3))])
    y = np.repeat([0, 1], [300, 100])
    for q in (0.1, 0.5, 0.9):
        r = quality.fit(x, y, {0: 300, 1: 100}, q)
        assert abs((r.score(x) < quality.ACCEPT).mean() - q) < 0.01 and abs(r.quantile - q) < 0.01
    # the plain version of the ranking: no step of the pairwise likelihood makes it better
    r = quality.fit(x, y, {0: 300, 1: 100})
    s = r.raw(x)
    assert (s[300:, None] > s[None, :300]).mean() > 0.98
    flat = quality.fit(np.ones((4, 3)), np.array([0, 1, 0, 1]), {0: 2, 1: 2})
    assert np.isfinite(flat.score(np.ones((2, 3)))).all() and flat.score(np.empty((0, 3))).shape == (0,)
    model = quality.train(odd, labels_of(spark))
    kept = quality.filter_documents(odd, model)
    scores = quality.score_documents(odd, model).where("predicted = 1").count()
    assert kept.columns == odd.columns and kept.count() == scores
    assert quality.filter_documents(nothing, model).count() == 0 and model.texts([]).shape == (0,)


def test_quality_learns_from_all(spark):
    """Means, pairs and threshold are those of all labelled documents, held against plain versions."""
    rng = random.Random(11)
    rows = []
    for i in range(14_000):
        y = int(rng.random() < 0.8)
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7 + y))) for _ in range(rng.randint(1, 12 + 3 * y))]
        rows.append((i, " ".join(words) + rng.choice(["", ".", "!", " 12", " A"] if y else ["", "##", "||", " 12", "\n\n"]), y))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(rows[0][0], rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    learned = [r for r in [*rows, rows[0]] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = np.array([quality.features(r[1]) for r in learned]), np.array([r[2] for r in learned])
    got = quality.train(docs, labels)
    assert np.allclose(got.mean, x.mean(0), rtol=1e-12) and np.allclose(got.scale, np.maximum(x.std(0), 1e-9), rtol=1e-9)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-9), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp((good @ got.weights)[:, None] - bad @ got.weights))
    slope = (p.sum(0) @ bad - p.sum(1) @ good) / p.size + got.weights / quality.PRIOR
    assert len(good) > 8000 and np.abs(slope).max() < 1e-7
    s = got.raw(x)
    shares = [((s < t) & (y == 0)).sum() / len(bad) - ((s < t) & (y == 1)).sum() / len(good) for t in (got.threshold, *np.quantile(s, np.linspace(0, 1, 400)))]
    assert shares[0] >= max(shares) and abs(got.quantile - (s < got.threshold).mean()) < 1e-9
    held = quality.fit(x, y, {0: len(bad), 1: len(good)})
    assert np.allclose(held.score(x), got.score(x), atol=1e-6)
    q = quality.train(docs, labels, quantile=0.3)
    s = q.raw(x)
    assert (s < q.threshold).mean() <= 0.3 < (s <= s[s > q.threshold].min()).mean()


def test_rules_filter(odd, nothing, spark):
    good = "The cat and the dog went to the house on the hill, and " * 6
    words = " ".join(f"word{i} the thing{i}" for i in range(40))
    rows = [(1, words, 1), (1, words, 1), (None, words.upper(), 2), (3, None, 3), (4, good, 4), (5, " ".join(f"zzz{i}" for i in range(99)), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _w int")
    got = Counter(tuple(r) for r in rules.filter_documents(df).collect())
    assert got == Counter(r for r in rows if r[2] in (1, 2))
    assert rules.filter_documents(odd).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(300)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (1150, [None] * 8), (None, [1.0] * 8), (1200, []), (1250, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in topk.top_k(df, "id % 50 = 0").orderBy("query_id", "rank").collect()]
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want
    assert topk.top_k(df.limit(0), "id % 50 = 0").count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1)"), "id % 50 = 0").count() == 1


@pytest.mark.parametrize("scale", [1, 10**4])
def test_cover_tree(scale):
    rng = np.random.default_rng(scale)
    x = np.floor(rng.normal(size=(600, 6)) * scale)
    x = np.concatenate([x, np.repeat(x[:1], 90, 0)])
    t = topk.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for n, (lo, hi) in enumerate(t.stretch):
        assert (np.sqrt(((x[t.order[lo:hi]] - x[t.center[n]]) ** 2).sum(1)) <= t.radii[n]).all()
        assert all(lo <= a <= b <= hi for a, b in (t.stretch[c] for c in t.children[n]))


def test_pipeline(spark, smallest, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    seen = [docs]
    for name, stage in C.STAGES:
        stage(spark, seen[-1], smallest).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    start, good, ruled, unique, clean, packed = seen
    rows = {r["doc_id"]: r["text"] for r in ruled.collect()}
    kept = {i for i, _, c, k in brute.components(list(rows.items()), 5) if k}
    assert {r["doc_id"] for r in unique.collect()} == kept
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert set(after) == kept and all(n == len(t) for t, n in after.values())
    assert all(not brute.pii(t) for t, _ in after.values())
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    assert C.run(spark, smallest).count() == packed.count()


def test_digests(spark, smallest):
    r = queries.op7_pii(spark, smallest).where("n_email = 0 and n_ip = 0 and n_card = 0 and n_phone = 0").first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()
