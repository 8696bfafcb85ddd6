"""DuckDB SQL with the results of the catalogue's queries, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from ..sources.sections import CODE, DATA


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower(replace(strip_accents(coalesce({x}, '')), 'ß', 'ss')), '[\p{{L}}\p{{N}}]+')"


def jac(a: str, b: str) -> str:
    common = f"len(list_filter({a}, lambda z: list_contains({b}, z)))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {common} / (len({a}) + len({b}) - {common}) END)"


def names(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


CH = r"""
wd AS (SELECT doc_id, source, lang, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS g
  FROM documents WHERE text IS NOT NULL),
pc AS (SELECT *, len(w) AS n, unnest(range(CASE WHEN len(w) <= 128 THEN 1 ELSE ceil((len(w) - 128) / 112.0)::INT + 1 END)) AS p FROM wd WHERE len(w) > 0),
ch AS (SELECT doc_id, source, lang, p::INT AS piece, doc_id || ':' || p AS chunk_id,
  array_to_string(list_transform(range(p * 112 + 1, least(n, p * 112 + 128) + 1), lambda i: (CASE WHEN i = p * 112 + 1 THEN '' ELSE g[i] END) || w[i]), '') AS chunk_text,
  (least(n, p * 112 + 128) - p * 112)::INT AS token_count FROM pc)"""
CT = f"ct AS (SELECT chunk_id, {tok('chunk_text')} AS t FROM ch)"
QT = f"qt AS (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark)"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def top(source: str, k: int | None, tie: str, cols: str) -> str:
    limit = "" if k is None else f" WHERE rank <= {k}"
    return f"(SELECT query_id, rank::INT AS rank, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM {source}){limit})"


POST = """
po AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM ct) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct)"""
SC = f"sc AS (SELECT query_id, chunk_id, round(sum({IDF}), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2)"
LEX = f"{CH}, {CT}, {QT}, {POST}, {SC}"
CA = f"{LEX}, ca AS {top('sc', 20, 'chunk_id', 'chunk_id, score')}"
IT = f"""{CA},
qq AS (SELECT item_id AS query_id, text AS query, list_distinct({tok('text')}) AS q FROM benchmark),
it0 AS (SELECT ca.*, q, t, list_distinct(t) AS terms, token_count, round(len(list_filter(q, lambda x: list_contains(t, x))) / len(q), 6) AS grounding,
  round(len(list_filter(t, lambda x: list_contains(q, x))) / token_count, 6) AS density
  FROM ca JOIN ch USING (chunk_id) JOIN ct USING (chunk_id) JOIN qq USING (query_id)),
it AS (SELECT *, grounding < 0.10 AS is_distractor FROM it0)"""


def multi(rows: str, fields: dict[str, tuple[str, float]], terms: str, key_type: str = "") -> str:
    """BM25 over several fields of (chunk_id, ...) rows; ``terms``: CTE qt (query_id, term, times)."""
    f = " UNION ALL ".join(f"SELECT '{n}' AS field, {w} AS w, chunk_id, {c} AS t FROM {rows}" for n, (c, w) in fields.items())
    return f"""mf AS ({f}),
mp AS (SELECT field, w, term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, w, chunk_id, len(t) AS dl, unnest(t) AS term FROM mf) GROUP BY 1, 2, 3, 4),
md AS (SELECT field, term, count(*) AS df FROM mp GROUP BY 1, 2),
ms AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM mf GROUP BY 1),
{terms},
msc AS (SELECT query_id, chunk_id, round(sum(w * times * {IDF}), 6) AS score FROM mqt JOIN mp USING (term) JOIN md USING (field, term) JOIN ms USING (field) GROUP BY 1, 2)"""


MQT = "mqt AS (SELECT *, 1 AS times FROM qt)"
MULTI = multi("ch", {"text": (tok("chunk_text"), 1.0), "source": (tok("source"), 1.0), "heading": (tok("lang"), 1.0)}, MQT)
MULTI3 = multi("ch", {"text": (tok("chunk_text"), 1.0), "source": (tok("source"), 1.0), "heading": (tok("lang"), 3.0)}, MQT)
PN = "pn AS (SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name), pp AS (SELECT p_partkey AS chunk_id, p_name, p_type, p_brand FROM part)"


def grams(x: str, low: int, high: int) -> str:
    s = f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' '"
    each = f"flatten(list_transform(range({low}, {high + 1}), lambda m: list_transform(range(1, length(s) - m + 2), lambda i: substr(s, i, m))))"
    return f"(SELECT CASE WHEN trim(s) = '' THEN []::VARCHAR[] ELSE {each} END FROM (SELECT {s} AS s))"


def contexts(strategy: str, budget: int | None, vectors: bool = False) -> str:
    pick = {"raw_topk": "rank", "max_density": "-density, rank", "distractor_filtered": "rank", "redundancy_pruned": "rank"}
    order = pick.get(strategy, "CASE WHEN strategy = 'raw_topk' THEN 0 ELSE is_distractor::INT END, CASE WHEN strategy = 'raw_topk' THEN 0 ELSE -grounding END, rank")
    keep = "NOT is_distractor" if strategy == "distractor_filtered" else "(strategy = 'raw_topk' OR NOT is_distractor OR is_rescued)" if strategy in ("auto", "reasoning_preserving") else "true"
    resolved = "CASE WHEN input_tokens <= 1500 THEN 'raw_topk' ELSE 'reasoning_preserving' END" if strategy == "auto" else f"'{strategy}'"
    fresh = f"len(list_filter(a.terms, lambda u: {jac('u', 'x.terms')} >= 0.9)) = 0" if strategy == "redundancy_pruned" else "true"
    held, none, more = "terms", "[]::VARCHAR[][]", ""
    if vectors:
        held, none = "{'t': terms, 'v': embedding::DOUBLE[]}", "[]::STRUCT(t VARCHAR[], v DOUBLE[])[]"
        more = " LEFT JOIN embeddings ON vec_id = split_part(chunk_id, ':', 1)::BIGINT"
        fresh = f"len(list_filter(a.terms, lambda u: CASE WHEN u.v IS NOT NULL AND x.terms.v IS NOT NULL THEN list_cosine_similarity(u.v, x.terms.v) > 0.92 ELSE {jac('u.t', 'x.terms.t')} >= 0.9 END)) = 0"
    most = 2**62 if budget is None else budget
    return f"""{IT},
se AS (SELECT query_id, list(terms) AS st FROM it WHERE NOT is_distractor GROUP BY 1),
tot AS (SELECT query_id, sum(token_count) AS input_tokens FROM it GROUP BY 1),
ir AS (SELECT it.*, {resolved} AS strategy, is_distractor AND len(list_filter(coalesce(st, []), lambda u: {jac('u', 'it.terms')} >= 0.12)) > 0 AS is_rescued
  FROM it JOIN tot USING (query_id) LEFT JOIN se USING (query_id)),
od AS (SELECT query_id, list({{'id': chunk_id, 'tc': token_count::BIGINT, 'terms': {held}}} ORDER BY {order}) AS l FROM ir{more} WHERE {keep} GROUP BY 1),
fi AS (SELECT query_id, list_reduce(list_transform(l, lambda x: {{'used': x.tc, 'ids': [x.id], 'terms': [x.terms]}}),
  lambda a, y: CASE WHEN a.used + y.used <= {most} AND len(list_filter(y.terms, lambda v: {fresh.replace('x.terms', 'v')})) > 0
    THEN {{'used': a.used + y.used, 'ids': list_concat(a.ids, y.ids), 'terms': list_concat(a.terms, y.terms)}} ELSE a END,
  {{'used': 0::BIGINT, 'ids': []::VARCHAR[], 'terms': {none}}}) AS f FROM od),
sel AS (SELECT query_id, any_value(strategy) AS strategy, coalesce(any_value(f).ids, []) AS ids, coalesce(any_value(f).used, 0) AS used FROM ir LEFT JOIN fi USING (query_id) GROUP BY 1),
cx AS (SELECT query_id, sel.strategy, array_to_string(any_value(ids), ',') AS selected, count(*) AS n_input, sum(token_count)::BIGINT AS input_tokens,
  len(any_value(ids))::BIGINT AS n_selected, any_value(used)::BIGINT AS total_tokens, count(*) FILTER (is_distractor) AS n_distractors,
  count(*) FILTER (is_rescued AND list_contains(ids, chunk_id)) AS n_rescued, round(count(*) FILTER (is_distractor) / count(*), 6) AS distractor_ratio,
  round(CASE WHEN count(*) FILTER (NOT is_distractor) = 0 THEN 1.0 ELSE count(*) FILTER (NOT is_distractor AND list_contains(ids, chunk_id)) / count(*) FILTER (NOT is_distractor) END, 6) AS retained,
  coalesce(bool_and(grounding <= 0.10) FILTER (list_contains(ids, chunk_id)), true) AS low_confidence
  FROM ir JOIN sel USING (query_id) GROUP BY 1, 2)"""


def widened(automatic: bool) -> str:
    code = f"regexp_extract(lower(source), '\\.([a-z0-9]+)$', 1) IN ({names(CODE)})"
    prose = f"regexp_extract(lower(source), '\\.([a-z0-9]+)$', 1) NOT IN ({names(CODE + DATA)}) AND length(trim(lang)) > 0"
    near, head = ("coalesce(hc, false)", "coalesce(hh, false)") if automatic else ("true", "true")
    return f"""WITH {contexts("auto", 4096)},
fl AS (SELECT query_id, bool_or({code}) AS hc, bool_or({prose}) AS hh FROM ca JOIN ch USING (chunk_id) GROUP BY 1),
sd AS (SELECT query_id, seed, nth, doc_id, piece, source, lang, hc, hh FROM (SELECT query_id, unnest(ids) AS seed, unnest(range(len(ids))) AS nth FROM sel) JOIN ch ON chunk_id = seed JOIN fl USING (query_id)),
fo AS (SELECT source, lang, arg_min(chunk_id, (doc_id, piece)) AS companion FROM ch WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT query_id, ch.chunk_id AS companion, nth * 3 + CASE WHEN ch.piece < sd.piece THEN 0 ELSE 1 END AS o FROM sd JOIN ch ON ch.doc_id = sd.doc_id AND abs(ch.piece - sd.piece) = 1 WHERE {near}
  UNION ALL SELECT query_id, companion, nth * 3 + 2 FROM sd JOIN fo USING (source, lang) WHERE companion <> seed AND {head}),
fr AS (SELECT query_id, companion, min(o) AS o FROM pl JOIN sel USING (query_id) WHERE NOT list_contains(ids, companion) GROUP BY 1, 2),
ml AS (SELECT query_id, list({{'used': token_count::BIGINT, 'ids': [companion]}} ORDER BY o) AS l FROM fr JOIN ch ON chunk_id = companion GROUP BY 1),
ex AS (SELECT query_id, ids, list_reduce(coalesce(l, []), lambda a, y: CASE WHEN a.used + y.used <= 4096 THEN {{'used': a.used + y.used, 'ids': list_concat(a.ids, y.ids)}} ELSE a END,
  {{'used': used::BIGINT, 'ids': []::VARCHAR[]}}) AS f FROM sel LEFT JOIN ml USING (query_id)),
so AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY doc_id, piece) AS placed FROM (SELECT query_id, unnest(list_concat(ids, f.ids)) AS chunk_id FROM ex) JOIN ch USING (chunk_id) GROUP BY 1)
SELECT query_id, CASE WHEN len(f.ids) > 0 THEN placed ELSE array_to_string(ids, ',') END AS selected, f.used AS total_tokens, (len(ids) + len(f.ids))::BIGINT AS n_selected, len(f.ids)::BIGINT AS n_expanded FROM ex LEFT JOIN so USING (query_id)"""


AUTO = contexts("auto", 2048)
RAW = contexts("raw_topk", 2048)
TEXT = "tx AS (SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY ord) AS context FROM (SELECT query_id, unnest(ids) AS chunk_id, unnest(range(len(ids))) AS ord FROM sel) JOIN ch USING (chunk_id) GROUP BY 1)"
SPREAD = """sp AS (SELECT query_id, n AS n_candidates, round(CASE WHEN n >= 2 AND top > 0 THEN least(1.0, greatest(0.0, (top - kth) / top)) END, 6) AS score_spread
  FROM (SELECT query_id, count(*) AS n, max(score) AS top, min(score) FILTER (rank <= 10) AS kth FROM ca GROUP BY 1))"""
VOCAB = "vo AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(t) AS term FROM ct) GROUP BY 1)"
DIAG = f"""{AUTO}, {SPREAD}, {VOCAB},
pt AS (SELECT query_id, count(*) AS n_terms, count(*) FILTER (coalesce(vo.df, 0) = 0) AS n_zero, count(*) FILTER (coalesce(vo.df, 0) > 0.25 * (SELECT count(*) FROM ch)) AS n_common
  FROM qt LEFT JOIN vo USING (term) GROUP BY 1),
db AS (SELECT qq.query_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_zero, 0) AS n_zero, coalesce(n_common, 0) AS n_common, coalesce(n_candidates, 0) AS n_candidates,
  score_spread, coalesce(n_selected, 0) = 0 AS em, coalesce(low_confidence, true) AS lo FROM qq LEFT JOIN pt USING (query_id) LEFT JOIN sp USING (query_id) LEFT JOIN cx USING (query_id)),
dh AS (SELECT *, n_terms >= 2 AND (em OR lo) AND n_zero / n_terms >= 0.5 AS mi FROM db),
dg AS (SELECT query_id, n_terms, n_zero, n_candidates, score_spread, array_to_string(list_filter([
  CASE WHEN em THEN 'empty_context' END, CASE WHEN mi THEN 'vocab_mismatch' END, CASE WHEN lo AND NOT em AND NOT mi THEN 'low_confidence' END,
  CASE WHEN n_terms >= 8 AND n_common / n_terms >= 0.6 THEN 'low_discrimination_query' END,
  CASE WHEN n_terms BETWEEN 1 AND 2 AND n_candidates >= 5 AND score_spread <= 0.15 THEN 'underdetermined_query' END], lambda h: h IS NOT NULL), ',') AS hints FROM dh)"""
DENSITY = f"dl AS (SELECT query_id, chunk_id, rank AS prior, round(density2, 6) AS score FROM (SELECT *, len(list_filter(list_filter(t, lambda x: length(x) > 1), lambda x: list_contains(list_filter(q, lambda y: length(y) > 1), x))) / len(t) AS density2 FROM it)), dn AS {top('dl', 20, 'prior', 'chunk_id, score')}"
FUSED = f"{IT}, {MULTI3}, mt AS {top('msc', 20, 'chunk_id', 'chunk_id, score')}, {DENSITY}"


def rerank(extra: str) -> str:
    q, t = "list_filter(q, lambda y: length(y) > 1)", "list_filter(t, lambda y: length(y) > 1)"
    e = f"len(list_filter({q}, lambda x: list_contains({t}, x))) / len({q})" if extra == "lexical" else f"len(list_filter({t}, lambda x: list_contains({q}, x))) / len(t)"
    return f"WITH {IT}, rr AS (SELECT query_id, chunk_id, rank AS prior, round(0.01 * score + {e}, 6) AS score FROM it) SELECT * FROM {top('rr', 10, 'prior', 'chunk_id, score')}"


def expand(both: bool) -> str:
    classes = [["the", "article"], ["de", "von", "of"], ["and", "und", "et"]]
    more = [
        f"CASE WHEN {' OR '.join(f'list_contains(t, {chr(39)}{k}{chr(39)})' for k in (c if both else c[:1]))} THEN list_filter([{names(c)}], lambda m: NOT list_contains(t, m)) ELSE []::VARCHAR[] END"
        for c in classes
    ]
    return f"SELECT item_id, array_to_string(list_concat([text], {', '.join(more)}), ' ') AS query FROM (SELECT item_id, text, {tok('text')} AS t FROM benchmark)"


BAD = names(["the", "of", "and", "de", "la", "der"])
LINES = "ln AS (SELECT {k}, unnest(string_split({t}, chr(10))) AS content, unnest(range(1, len(string_split({t}, chr(10))) + 1)) AS line FROM {f})"
STOPS = names(STOP_WORDS)

SQL: dict[str, str] = {
    "scan_documents": "SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2",
    "kind_projection": f"SELECT page_id, CASE WHEN e IN ({names(CODE)}) THEN 'code' WHEN e IN ({names(DATA)}) THEN 'data' ELSE 'prose' END AS kind FROM (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)",
    "blank_filter": "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) > 0 GROUP BY 1",
    "html_line_blocks": f"WITH {LINES.format(k='page_id', t='html', f='pages')}, isl AS (SELECT *, length(trim(content)) = 0 AS b, sum((length(trim(content)) = 0)::INT) OVER (PARTITION BY page_id ORDER BY line) AS island FROM ln) SELECT page_id, min(line)::BIGINT AS line, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars FROM isl WHERE NOT b GROUP BY page_id, island",
    "page_heading_rule": r"SELECT doc_id, CASE WHEN length(f) BETWEEN 4 AND 80 AND regexp_matches(f, '\p{L}') AND NOT regexp_matches(f, '[.,;:?!0-9]$') AND NOT regexp_matches(lower(f), '^(page |p\. |\[|[-*•])') THEN f END AS heading FROM (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS f FROM documents)",
    "markdown_heading_carry": "WITH " + LINES.format(k="doc_id", t="text", f="documents") + r""", m AS (SELECT *, regexp_matches(content, '^#{1,6}\s+\S') AS h FROM ln), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS section_idx FROM m)
SELECT doc_id, section_idx, max(CASE WHEN h THEN regexp_extract(content, '^#{1,6}\s+(.*?)\s*#*\s*$', 1) END) AS heading, min(line)::BIGINT AS line, length(string_agg(content, chr(10) ORDER BY line))::BIGINT AS n_chars FROM s GROUP BY 1, 2 HAVING length(trim(string_agg(content, chr(10) ORDER BY line))) > 0""",
    "tokens_raw": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY 1, 2",
    "tokens_char_ngram": f"SELECT gram, count(*) AS n FROM (SELECT unnest({grams('p_name', 3, 5)}) AS gram FROM part) GROUP BY 1",
    "camel_split": r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+')) AS piece FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)) WHERE piece <> '' GROUP BY 1",
    "sanitize_query": r"SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[-+:*?^~\\()\[\]{}"+'"'+r"<>]', ' ', 'g')), '\s+', ' ', 'g')) AS query FROM conversations",
    "chunk_fixed": f"WITH {CH} SELECT chunk_id, piece, token_count, md5(chunk_text) AS text_md5 FROM ch",
    "chunk_index_stamp": f"WITH {CH} SELECT chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::BIGINT AS chunk_index FROM ch",
    "field_stats": f"WITH {CH} SELECT 'text' AS field, count(*) AS n, round(avg(len({tok('chunk_text')})), 6) AS avgdl FROM ch UNION ALL SELECT 'source', count(*), round(avg(len({tok('source')})), 6) FROM ch UNION ALL SELECT 'heading', count(*), round(avg(len({tok('lang')})), 6) FROM ch",
    "vocab_df": f"WITH {CH}, {CT}, {VOCAB} SELECT * FROM vo",
    "postings_tf": f"WITH {CH}, {CT}, {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM po GROUP BY 1",
    "query_set_report": r"""WITH q AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: strlen(w) > 1) AS t FROM conversations WHERE role = 'user'),
d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM q) GROUP BY 1), b AS (SELECT coalesce(list(term ORDER BY df DESC, term), []) AS bp FROM d WHERE df >= ceil(0.8 * (SELECT count(*) FROM q))),
s AS (SELECT round(coalesce(avg(len(list_filter(t, lambda w: list_contains(bp, w))) / len(t)), 0), 6) AS share, any_value(bp) AS bp FROM q, b WHERE len(t) > 0)
SELECT (SELECT count(*) FROM q) AS n_queries, share, array_to_string(bp, ',') AS boilerplate, share >= 0.5 AND len(bp) >= 2 AS templated, CASE WHEN share >= 0.7 THEN 'high' WHEN share >= 0.4 THEN 'medium' WHEN share >= 0.2 THEN 'low' ELSE 'none' END AS cost FROM s""",
    "bm25_topk": f"WITH {CA} SELECT * FROM ca",
    "bm25_multifield": f"WITH {CH}, {QT}, {MULTI} SELECT * FROM {top('msc', 20, 'chunk_id', 'chunk_id, score')}",
    "bm25_weighted": "WITH " + PN + ", " + multi("pp", {"text": (tok("p_name"), 1.0), "source": (tok("p_type"), 1.0), "heading": (tok("p_brand"), 2.0)}, f"mqt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term, 1 AS times FROM pn)") + f" SELECT * FROM {top('msc', 20, 'chunk_id', 'chunk_id, score')}",
    "bm25_subword": "WITH " + PN + ", " + multi("pp", {"text": (grams("p_name", 3, 4), 1.0)}, f"mqt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({grams('query', 3, 4)}) AS term FROM pn) GROUP BY 1, 2)") + f" SELECT * FROM {top('msc', 20, 'chunk_id', 'chunk_id, score')}",
    "bm25_phrase": f"WITH {PN}, t AS (SELECT chunk_id, {tok('p_name')} AS t FROM pp), q AS (SELECT query_id, {tok('query')} AS q FROM pn) SELECT query_id, chunk_id, hits FROM (SELECT query_id, chunk_id, len(list_filter(range(1, len(t)), lambda i: t[i] = q[1] AND t[i + 1] = q[2]))::BIGINT AS hits FROM q, t WHERE len(q) = 2) WHERE hits > 0",
    "dense_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT * FROM " + top("s", 10, "vec_id", "vec_id, score"),
    "hybrid_local_rerank": f"WITH {LEX}, pl AS {top('sc', 50, 'chunk_id', 'chunk_id, score')}, dn AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dense FROM pl JOIN ch USING (chunk_id) JOIN embeddings v ON v.vec_id = doc_id JOIN embeddings q ON q.vec_id = query_id), r AS (SELECT query_id, chunk_id, pl.score AS lexical, dense, row_number() OVER (PARTITION BY query_id ORDER BY dense IS NULL, dense DESC, rank)::INT AS rank FROM pl LEFT JOIN dn USING (query_id, chunk_id)) SELECT * FROM r WHERE rank <= 20",
    "fuse_rrf": f"WITH {FUSED}, u AS (SELECT query_id, rank, chunk_id FROM mt UNION ALL SELECT query_id, rank, chunk_id FROM dn), f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2) SELECT * FROM {top('f', 20, 'chunk_id', 'chunk_id, score')}",
    "fuse_weighted": f"WITH {FUSED}, u AS (SELECT query_id, chunk_id, 0.7 * (CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END) AS p FROM mt WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, chunk_id, 0.3 * (CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END) FROM dn WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, chunk_id, round(sum(p), 6) AS score FROM u GROUP BY 1, 2) SELECT * FROM {top('f', 20, 'chunk_id', 'chunk_id, score')}",
    "min_candidates_topup": f"WITH {CA}, fw AS (SELECT * FROM ca WHERE score >= 60), hv AS (SELECT query_id, count(*) AS have FROM fw GROUP BY 1), mo AS (SELECT ca.*, coalesce(have, 0) AS have, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS nth FROM ca LEFT JOIN hv USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.query_id = ca.query_id AND fw.chunk_id = ca.chunk_id)) SELECT query_id, rank::BIGINT AS rank, chunk_id, score, false AS added FROM fw UNION ALL SELECT query_id, have + nth, chunk_id, score, true FROM mo WHERE nth <= 10 - have",
    "rerank_lexical": rerank("lexical"),
    "rerank_density": rerank("density"),
    **{f"ctx_{s}": f"WITH {contexts(s, 2048)} SELECT * FROM cx" for s in ("raw_topk", "distractor_filtered", "redundancy_pruned", "max_density", "reasoning_preserving", "auto")},
    "ctx_redundancy_cosine": f"WITH {contexts('redundancy_pruned', 2048, True)} SELECT * FROM cx",
    "ctx_vector_spread": f"WITH {IT}, ve AS (SELECT it.*, embedding::DOUBLE[] AS v FROM it LEFT JOIN embeddings ON vec_id = split_part(chunk_id, ':', 1)::BIGINT), pa AS (SELECT a.query_id, avg(list_cosine_similarity(a.v, b.v)) AS c FROM ve a JOIN ve b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1) SELECT query_id, round(any_value(c), 5) AS mean_cosine, round(sum(token_count) / 2048, 6) AS utilisation FROM it LEFT JOIN pa USING (query_id) GROUP BY 1",
    "ctx_report": f"WITH {AUTO} SELECT query_id, 'strategy: ' || strategy || chr(10) || 'chunks: ' || n_selected || ' of ' || n_input || chr(10) || 'tokens: ' || total_tokens || ' of ' || input_tokens || chr(10) || 'distractors: ' || round(100 * distractor_ratio)::INT || '%' || chr(10) || 'evidence retained: ' || round(100 * retained)::INT || '%' || CASE WHEN n_selected = 0 THEN chr(10) || 'warning: the context is empty' WHEN low_confidence THEN chr(10) || 'warning: no chunk holds much of the query' ELSE '' END AS report FROM cx",
    "ctx_filter": f"WITH {contexts('distractor_filtered', None)} SELECT * FROM cx",
    "ctx_economics": f"WITH {IT} SELECT query_id, sum(token_count)::BIGINT AS total_tokens, round(coalesce(sum(token_count) FILTER (NOT is_distractor), 0) / sum(token_count), 6) AS relevant_share, round(count(*) FILTER (is_distractor) / count(*), 6) AS distractor_ratio, coalesce(sum(token_count) FILTER (is_distractor), 0)::BIGINT AS waste_tokens, round(avg(density), 6) AS mean_density FROM it GROUP BY 1",
    "ctx_text": f"WITH {AUTO}, {TEXT} SELECT query_id, md5(context) AS context_md5 FROM tx",
    "ctx_preserve_order": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ord FROM conversations",
    "expand_neighbors": f"WITH {AUTO}, sd AS (SELECT query_id, unnest(ids) AS seed FROM sel) SELECT query_id, seed, b.chunk_id AS companion, (b.piece - a.piece)::BIGINT AS dist FROM sd JOIN ch a ON a.chunk_id = seed JOIN ch b ON a.doc_id = b.doc_id AND abs(b.piece - a.piece) BETWEEN 1 AND 2",
    "expand_heading": f"WITH {AUTO}, sd AS (SELECT query_id, unnest(ids) AS seed FROM sel), fo AS (SELECT source, lang, arg_min(chunk_id, (doc_id, piece)) AS companion FROM ch GROUP BY 1, 2) SELECT query_id, seed, companion FROM sd JOIN ch ON chunk_id = seed JOIN fo USING (source, lang) WHERE seed <> companion",
    "ctx_expanded": widened(False),
    "ctx_expanded_auto": widened(True),
    "score_spread": f"WITH {CA}, {SPREAD} SELECT * FROM sp",
    "diag_hints": f"WITH {DIAG} SELECT * FROM dg",
    "diag_summary": f"""WITH {DIAG}, s AS (SELECT count(*) AS n_queries, {', '.join(f"round(count(*) FILTER (contains(hints, '{h}')) / count(*), 6) AS {a}" for h, a in (('empty_context', 'empty_rate'), ('vocab_mismatch', 'vocab_rate'), ('low_confidence', 'low_rate'), ('low_discrimination_query', 'templated_rate'), ('underdetermined_query', 'under_rate')))}, round(avg(score_spread), 6) AS mean_spread FROM dg)
SELECT *, CASE WHEN n_queries < 20 THEN 'sample_too_small' WHEN vocab_rate >= 0.2 THEN 'vocab_mismatch' WHEN templated_rate >= 0.2 THEN 'templated_queries' WHEN under_rate >= 0.2 THEN 'underdetermined_queries' WHEN low_rate + empty_rate >= 0.3 THEN 'weak_retrieval' ELSE 'healthy' END AS focus FROM s""",
    "rw_strip": rf"SELECT item_id, array_to_string(list_filter(w, lambda x: NOT list_has_any({tok('x')}, [{BAD}])), ' ') AS kept, array_to_string(list_sort(list_filter(w, lambda x: list_has_any({tok('x')}, [{BAD}]))), ',') AS removed FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)",
    "rw_vocab": expand(False),
    "rw_vocab_bidirectional": expand(True),
    "eval_recall_precision": f"WITH {RAW}, gd AS (SELECT query_id, list(chunk_id) AS gold FROM it WHERE grounding >= 0.9 GROUP BY 1), b AS (SELECT query_id, ids, coalesce(gold, []) AS gold FROM sel LEFT JOIN gd USING (query_id)), h AS (SELECT *, len(list_filter(gold, lambda x: list_contains(ids, x))) AS n FROM b) SELECT query_id, round(CASE WHEN len(gold) = 0 THEN 1.0 ELSE n / len(gold) END, 6) AS recall, round(CASE WHEN len(gold) > 0 THEN CASE WHEN len(ids) = 0 THEN 0.0 ELSE n / len(ids) END END, 6) AS precision FROM h",
    "eval_answer_recall": rf"WITH {RAW}, {TEXT}, e AS (SELECT query_id, q, list_distinct({tok('context')}) AS c, list_filter(list_transform(string_split(regexp_replace(query, '([.?!])([ \t\r\f])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM tx JOIN qq USING (query_id)), g AS (SELECT *, list_transform(ss, lambda s: list_distinct({tok('s')})) AS st FROM e) SELECT query_id, round(len(list_filter(q, lambda x: list_contains(c, x))) / len(q), 6) AS answer_recall, round(CASE WHEN len(st) > 0 THEN len(list_filter(st, lambda t: len(list_filter(t, lambda x: list_contains(c, x))) >= ceil(len(t) / 2))) / len(st) END, 6) AS faithfulness FROM g",
    "eval_set_coverage": f"WITH {contexts('raw_topk', 512)}, fm AS (SELECT query_id, split_part(chunk_id, ':', 1) AS family, bool_and(list_contains(ids, chunk_id)) AS whole FROM it JOIN sel USING (query_id) WHERE grounding >= 0.9 GROUP BY 1, 2), c AS (SELECT query_id, count(*) FILTER (whole) / count(*) AS c FROM fm GROUP BY 1) SELECT query_id, round(coalesce(c, 1.0), 6) AS coverage FROM sel LEFT JOIN c USING (query_id)",
    "eval_summary": f"WITH {RAW}, gd AS (SELECT query_id, list(chunk_id) AS gold FROM it WHERE grounding >= 0.9 GROUP BY 1), b AS (SELECT query_id, ids, coalesce(gold, []) AS gold FROM sel LEFT JOIN gd USING (query_id)), h AS (SELECT *, len(list_filter(gold, lambda x: list_contains(ids, x))) AS n FROM b), e AS (SELECT round(CASE WHEN len(gold) = 0 THEN 1.0 ELSE n / len(gold) END, 6) AS recall, round(CASE WHEN len(gold) > 0 THEN n / len(ids) END, 6) AS precision FROM h) SELECT count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, count(precision) AS n_precision, quantile_disc(recall, 0.5) AS median_recall FROM e",
    "rerank_fusion": f"WITH {LEX}, pl AS {top('sc', 50, 'chunk_id', 'chunk_id, score')}, dn AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dense FROM pl JOIN ch USING (chunk_id) JOIN embeddings v ON v.vec_id = doc_id JOIN embeddings q ON q.vec_id = query_id), r AS (SELECT query_id, chunk_id, round(pl.score + 2.0 * coalesce(dense, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dense IS NULL, dense DESC, rank) AS prior FROM pl LEFT JOIN dn USING (query_id, chunk_id)), f AS (SELECT * FROM r WHERE prior <= 20) SELECT * FROM {top('f', 10, 'prior', 'chunk_id, score')}",
    "recall_at_k": f"WITH {IT}, h AS (SELECT query_id, min(rank) AS f FROM it WHERE grounding >= 0.9 GROUP BY 1), r AS (SELECT item_id, f FROM benchmark LEFT JOIN h ON query_id = item_id) SELECT count(*) AS n, round(avg((coalesce(f, 1000000) <= 1)::INT), 6) AS r_at_1, round(avg((coalesce(f, 1000000) <= 3)::INT), 6) AS r_at_3, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM r",
    "prf_terms": f"WITH {IT}, p AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, q, unnest(t) AS term FROM it) WHERE NOT list_contains(q, term) AND length(term) >= 3 AND term NOT IN ({STOPS}) GROUP BY 1, 2) SELECT query_id, term, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS nth FROM p) WHERE nth <= 5",
    "drop_low_idf": f"WITH {CH}, {CT}, {VOCAB}, q AS (SELECT item_id AS query_id, list_distinct({tok('text')}) AS d, {tok('text')} AS t FROM benchmark), u AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM q) GROUP BY 1, 2) SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS query FROM u LEFT JOIN vo USING (term) WHERE coalesce(df, 0) <= ceil((SELECT count(*) FROM ch) * 0.2) OR length(term) < 3 GROUP BY 1",
    "latency_percentile": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1",
    "judge_parse_score": r"WITH a AS (SELECT conv_id, turn, lower(trim(regexp_split_to_array(text, '\s+')[-1])) AS s FROM conversations), b AS (SELECT *, try_cast(nullif(regexp_extract(s, '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS n FROM a) SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^(yes|true)') THEN 1.0 WHEN regexp_matches(s, '^(no|false)') THEN 0.0 WHEN n < 0 THEN 0.0 WHEN regexp_matches(s, '[0-9]\s*%') OR n > 1 THEN least(n / 100, 1.0) ELSE n END::DOUBLE AS score FROM b",
    "diag_terms": f"WITH {IT}, {VOCAB}, u AS (SELECT query_id, flatten(list(terms)) AS al FROM it GROUP BY 1), o AS (SELECT item_id AS query_id, {tok('text')} AS t FROM benchmark), e AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM o) GROUP BY 1, 2), j AS (SELECT e.*, coalesce(vo.df, 0) AS df, list_contains(coalesce(al, []), e.term) AS seen FROM e LEFT JOIN vo USING (term) LEFT JOIN u USING (query_id)) SELECT query_id, coalesce(string_agg(term, ',' ORDER BY pos) FILTER (NOT seen), '') AS unmatched_terms, coalesce(string_agg(term, ',' ORDER BY pos) FILTER (df = 0), '') AS zero_match_terms, round(max(df / (SELECT count(*) FROM ch)), 6) AS max_df_ratio FROM j GROUP BY 1",
    "diag_top_zero_terms": f"WITH {CH}, {CT}, {VOCAB}, o AS (SELECT DISTINCT item_id, unnest({tok('text')}) AS term FROM benchmark), c AS (SELECT term, count(*) AS n FROM o WHERE term NOT IN (SELECT term FROM vo) GROUP BY 1) SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS nth FROM c QUALIFY nth <= 20",
    "ctx_analyze": f"WITH {IT}, se AS (SELECT query_id, list(terms) AS st FROM it WHERE NOT is_distractor GROUP BY 1) SELECT query_id, count(*) AS n_input, sum(token_count)::BIGINT AS input_tokens, round(count(*) FILTER (is_distractor) / count(*), 6) AS distractor_ratio, count(*) FILTER (is_distractor AND len(list_filter(coalesce(st, []), lambda x: {jac('x', 'it.terms')} >= 0.12)) > 0) AS n_rescuable, bool_and(grounding <= 0.10) AS low_confidence, CASE WHEN sum(token_count) <= 1500 THEN 'passthrough' ELSE 'prune' END AS decision FROM it LEFT JOIN se USING (query_id) GROUP BY 1",
    "span_recall": f"WITH {RAW}, {TEXT}, e AS (SELECT query_id, {tok('query')} AS g, {tok('context')} AS c FROM tx JOIN qq USING (query_id)) SELECT query_id, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_filter(list_distinct(g), lambda x: list_contains(c, x))) / len(list_distinct(g)) END, 6) AS by_set, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_filter(g, lambda x: list_contains(c, x))) / len(g) END, 6) AS by_list FROM e",
    "judge_agreement": "SELECT count(*) AS n, round(corr(quality, toxic), 6) AS pearson, round(avg(abs(quality - toxic)), 6) AS mae FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "greedy_fill": f"WITH {CA}, w AS (SELECT query_id, rank, chunk_id, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM ca JOIN ch USING (chunk_id)) SELECT * FROM w WHERE used <= 1000",
    "f_beta": "WITH l AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels) SELECT tp, fp, fn, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM l",
    "incremental_upsert": "SELECT doc_id::VARCHAR AS source, md5(text) AS stamp, length(text)::BIGINT AS length, CASE WHEN length(text) <= 1000 THEN 'add' WHEN length(text) > 2000 THEN 'reuse' ELSE 'replace' END AS action FROM documents",
    "windowed_audit": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
}
