"""DuckDB SQL for the queries of ``queries.py``, written from what they mean and not from how Spark runs them."""

from __future__ import annotations

from leafstack.config import DEFAULTS as S
from leafstack.functions.quality import FREQUENT_WORDS
from leafstack.functions.text import POINT_NAMESPACE, STOPWORDS
from leafstack.plans.prompts import NOTHING_FOUND
from leafstack.queries import BOOK, BY_HAND, HEADINGS, LAID_OUT, LITERALS, REWRITES, SMALL, SOURCES, STYLES

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_FREQUENT = "[" + ", ".join(f"'{w}'" for w in FREQUENT_WORDS) + "]"
_DEV = r"\x{0900}-\x{097F}"
_DEV_LETTERS = r"\x{0900}-\x{0963}\x{0971}-\x{097F}"
_EDGE = r"^[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x1c-\x1f]+|[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x1c-\x1f]+$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_EDGE}', '', 'g')"


_TEXTS = f"""texts AS (
  SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'literals', CAST(id AS BIGINT), text FROM (VALUES {LITERALS}) AS t(id, text)
)"""


def _normal(x: str) -> str:
    x = rf"regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g')"
    for _ in range(2):  # a boundary between two pipes belongs to both
        x = rf"regexp_replace({x}, '([{_DEV}\s])\|\|(\s|$)', '\1॥\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([{_DEV}\s])\|(\s|$)', '\1।\2', 'g')"
    x = rf"regexp_replace({x}, '।\s*।', '॥', 'g')"
    x = rf"regexp_replace({x}, '[ \t\x{{00a0}}\x{{200b}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[ \t\x0b\f\r]*\n[ \t\x0b\f\r]*', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(x)


def _sentences(x: str) -> str:
    x = rf"regexp_replace({x}, '([।॥?!])\s+', '\1' || chr(1), 'g')"
    x = rf"""regexp_replace({x}, '(\.)\s+([A-Z{_DEV}"“''])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({x}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _terms(x: str) -> str:
    x = f"replace(replace(nfc_normalize(lower({x})), '़', ''), 'ँ', 'ं')"
    x = rf"regexp_extract_all({x}, '[a-z0-9]+|[\x{{0900}}-\x{{0963}}\x{{0966}}-\x{{097F}}]+')"
    return f"list_filter({x}, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


_WEIGHT = f"tf * {S.bm25_k1 + 1} / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * n / {S.bm25_avg_len}))"
_INDEX = f"""lists AS (SELECT doc_id, {_terms('text')} AS terms FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM lists) GROUP BY ALL),
weights AS (SELECT doc_id, term, tf, {_WEIGHT} AS weight FROM counted),
freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
idf AS (SELECT term, df, ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS idf FROM freq),
asked AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark)"""


def _sparse(k: int, where: str = "true") -> str:
    return f"""{_INDEX},
sparse_scores AS (SELECT item_id, doc_id, round(sum(idf * weight), 6) AS score FROM asked JOIN weights USING (term) JOIN idf USING (term) WHERE {where} GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sparse_scores) WHERE rank <= {k})"""


_UNIT = "list_transform(v, lambda x: x / CASE WHEN sqrt(list_inner_product(v, v)) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END)"
_VECTORS = f"""raw_v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), unit AS (SELECT vec_id, {_UNIT} AS v FROM raw_v)"""


def _dense(name: str, k: int, shift: int = 0, only: str = "true") -> str:
    return f"""{name}_scores AS (SELECT b.item_id - {shift} AS item_id, u.vec_id, round(list_inner_product(u.v, q.v), 6) AS score FROM benchmark b JOIN unit q ON q.vec_id = b.item_id CROSS JOIN unit u WHERE {only}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM {name}_scores) WHERE rank <= {k})"""


def _hybrid(only_dense: str, only_sparse: str) -> str:
    return f"""WITH {_sparse(S.prefetch_k, only_sparse)}, {_VECTORS}, {_dense('dense', S.prefetch_k, only=f'u.vec_id IN (SELECT doc_id FROM documents) AND {only_dense}')},
fused AS (SELECT item_id, doc_id, round(sum(1.0 / ({S.rrf_k} + CAST(rank AS DOUBLE))), 6) AS score FROM (SELECT item_id, vec_id AS doc_id, rank FROM dense UNION ALL SELECT item_id, doc_id, rank FROM sparse) GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {S.top_k}"""


_QUALITY = rf"""bare AS (SELECT *, {_strip('text')} AS b FROM pages_),
words AS (SELECT *, regexp_extract_all(b, '[{_DEV}]+') AS w, len(regexp_extract_all(b, '[A-Za-z]{{2,}}')) AS latin FROM bare),
rates AS (SELECT *, len(w) AS n, length(b) AS chars,
  len(list_filter(w, lambda x: regexp_matches(x, '^[\x{{0901}}-\x{{0903}}\x{{093E}}-\x{{094D}}\x{{0962}}\x{{0963}}]'))) / nullif(len(w), 0) AS orphan,
  len(list_filter(w, lambda x: list_contains({_FREQUENT}, x))) / nullif(len(w), 0) AS frequent,
  len(regexp_extract_all(b, '\x{{094D}}[\x{{093E}}-\x{{094C}}]')) AS vm FROM words),
judged AS (SELECT *, chars >= 40 AND n > 0 AND n >= 0.2 * (n + latin) AS j FROM rates),
quality AS (SELECT *, CASE WHEN chars < 40 THEN true WHEN NOT j THEN false ELSE orphan > 0.01 OR vm > 0 OR (n > 80 AND frequent < 0.004) END AS needs_ocr FROM judged)"""

_TURNS = "SELECT * FROM conversations WHERE role <> 'system'"
_BACK = f"back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM ({_TURNS}))"


def _packed(sentences: str, key: str) -> str:
    """Chunks from rows (key, part, page, section, list of sentences): the chain of starts over closed-form ends."""
    return f"""WITH RECURSIVE lists AS ({sentences}),
sents AS (SELECT {key}, part, page, section, unnest(list_zip(s, range(1, len(s) + 1))) AS z FROM lists),
numbered AS (SELECT {key}, part, page, section, CAST(z[2] AS BIGINT) AS i, z[1] AS s FROM sents),
ends AS (SELECT {key}, part, i, CAST(sum(length(s) + 1) OVER (PARTITION BY {key}, part ORDER BY i) AS BIGINT) AS p FROM numbered
  UNION ALL SELECT {key}, part, 0, 0 FROM lists WHERE len(s) > 0),
total AS (SELECT {key}, part, max(i) AS n FROM ends GROUP BY ALL),
stops AS (SELECT a.{key}, a.part, a.i AS start, max(b.i) AS stop FROM ends a JOIN ends b ON a.{key} = b.{key} AND a.part = b.part AND b.i > a.i AND b.i <= a.i + {S.chunk_size} AND (b.i = a.i + 1 OR b.p - a.p <= {S.chunk_size}) GROUP BY ALL),
nexts AS (SELECT s.{key}, s.part, s.start, s.stop, min(b.i) AS nxt FROM stops s JOIN ends e ON e.{key} = s.{key} AND e.part = s.part AND e.i = s.stop
  JOIN ends b ON b.{key} = s.{key} AND b.part = s.part AND b.i > s.start AND b.i <= s.stop AND (b.i = s.stop OR e.p - b.p <= {S.chunk_overlap} + 1) GROUP BY ALL),
chain AS (SELECT n.{key}, n.part, n.start, n.stop, n.nxt FROM nexts n WHERE n.start = 0
  UNION ALL SELECT n.{key}, n.part, n.start, n.stop, n.nxt FROM chain c JOIN total t ON t.{key} = c.{key} AND t.part = c.part JOIN nexts n ON n.{key} = c.{key} AND n.part = c.part AND n.start = c.nxt WHERE c.stop < t.n)
SELECT c.{key}, CAST(row_number() OVER (PARTITION BY c.{key} ORDER BY c.part, c.start) - 1 AS INTEGER) AS chunk_index,
  string_agg(x.s, ' ' ORDER BY x.i) AS text, CAST(min(x.page) AS INTEGER) AS page_start, CAST(max(x.page) AS INTEGER) AS page_end, any_value(x.section) AS section
FROM chain c JOIN numbered x ON x.{key} = c.{key} AND x.part = c.part AND x.i > c.start AND x.i <= c.stop GROUP BY c.{key}, c.part, c.start, c.stop"""


def _wrapped(x: str) -> str:
    """A long sentence as runs of words, each as long as fits."""
    words = f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    fits = f"length(string_split(acc, chr(2))[-1]) + 1 + length(w) <= {S.chunk_size}"
    return f"string_split(list_reduce({words}, lambda acc, w: acc || CASE WHEN {fits} THEN ' ' ELSE chr(2) END || w), chr(2))"


_BODY = rf"replace(replace({_strip('text')}, chr(10) || chr(10), chr(1)), chr(10), ' ')"

def _chunk_lists(docs: str) -> str:
    """The sentences of each document, long ones wrapped."""
    return f"SELECT doc_id, 1 AS part, 1 AS page, '' AS section, flatten(list_transform({_sentences(_BODY)}, lambda x: CASE WHEN length(x) > {S.chunk_size} THEN {_wrapped('x')} ELSE [x] END)) AS s FROM {docs}"


def passages(docs: str) -> str:
    """Chunks of the documents whose text can be trusted, with their language."""
    trusted = f"(SELECT doc_id, text FROM {docs} WHERE doc_id NOT IN (SELECT doc_id FROM (WITH pages_ AS (SELECT doc_id, text FROM {docs}), {_QUALITY} SELECT doc_id FROM quality WHERE needs_ocr)))"
    return f"SELECT p.*, d.lang FROM ({_packed(_chunk_lists(trusted), 'doc_id')}) p JOIN {docs} d USING (doc_id)"


def question_sheets() -> str:
    """A prompt with the passages that hybrid search finds for each benchmark item."""
    vectors = "u.vec_id IN (SELECT doc_id FROM documents)"
    return f"""WITH found AS ({_hybrid(vectors, 'true')}),
shown AS (SELECT item_id, count(*) AS hits, string_agg('[' || rank || '] ' || d.source || CASE WHEN d.lang = 'en' THEN '' ELSE ' | ' || d.lang END || ' | p. 1' || chr(10)
  || substr(d.text, 1, 700) || CASE WHEN length(d.text) > 700 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context FROM found JOIN documents d USING (doc_id) GROUP BY item_id)
SELECT item_id, CAST(coalesce(hits, 0) AS INTEGER) AS hits, 'Passages:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer in English.' AS prompt,
  CASE WHEN hits IS NULL THEN '{NOTHING_FOUND['English']}' END AS reply, 'benchmark' AS question_set FROM benchmark LEFT JOIN shown USING (item_id)"""


_LINES = f"""whole AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN translate(text, '{SMALL}', '{SMALL.upper()}') ELSE text END, chr(10)) AS l FROM documents),
zipped AS (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS z FROM whole),
lines AS (SELECT doc_id, z[2] AS para, z[1] AS text, {list(STYLES)}[(doc_id + z[2]) % {len(STYLES)} + 1] AS style FROM zipped)"""


def _heading(text: str, style: str) -> str:
    letters = rf"length(regexp_replace({text}, '[^\p{{L}}]', '', 'g'))"
    return rf"""CASE WHEN lower({style}) LIKE 'heading%' OR lower({style}) LIKE 'title%' THEN true WHEN length({text}) > 90 OR regexp_matches({text}, '[.,;:]$') THEN false
  WHEN {letters} < 2 THEN false WHEN length(regexp_replace({text}, '[^\p{{Lu}}]', '', 'g')) >= 0.9 * {letters} THEN true
  ELSE lower({style}) = 'center' AND length({text}) <= 60 AND NOT regexp_matches({text}, '[?!]$') END"""


def _devanagari(x: str) -> str:
    return rf"coalesce(length(regexp_replace({x}, '[^{_DEV_LETTERS}]', '', 'g')) / nullif(length(regexp_replace({x}, '[^\p{{L}}\p{{M}}]', '', 'g')), 0) >= 0.3, false)"


_CONTEXT = """SELECT item_id, string_agg('[' || rank || '] ' || d.source || CASE WHEN d.lang = 'en' THEN '' ELSE ' | ' || d.lang END || ' | ' || CASE WHEN d.doc_id % 2 = 0 THEN 'p. 1' ELSE 'pp. 1-2' END || chr(10)
  || substr(d.text, 1, 700) || CASE WHEN length(d.text) > 700 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context FROM sparse JOIN documents d USING (doc_id) GROUP BY item_id"""

_LIMITS = """WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, true AS admitted, CAST(NULL AS INTEGER) AS retry_after, [t] AS recent FROM h WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, t, k, len(w) < 2, CASE WHEN len(w) >= 2 THEN CAST(floor(21600 - (t - w[1]) / 1e6) AS INTEGER) + 1 END, CASE WHEN len(w) < 2 THEN list_append(w, t) ELSE w END
  FROM (SELECT h.user_id, h.event_id, h.t, h.k, list_filter(f.recent, lambda x: x >= h.t - 21600000000) AS w FROM f JOIN h ON h.user_id = f.user_id AND h.k = f.k + 1))
SELECT user_id, event_id, admitted, coalesce(retry_after, 0) AS retry_after FROM f"""

SQL: dict[str, str] = {
    "normalize_text": f"WITH {_TEXTS} SELECT origin, id, {_normal('text')} AS normal FROM texts",
    "is_devanagari_share": rf"""WITH {_TEXTS}, n AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^{_DEV_LETTERS}]', '', 'g')) AS own FROM texts)
SELECT origin, id, round(own / nullif(letters, 0), 6) AS share, coalesce(own / nullif(letters, 0) >= 0.3, false) AS devanagari FROM n""",
    "split_sentences": f"""WITH {_TEXTS}, lists AS (SELECT origin, id, {_sentences('text')} AS s FROM texts)
SELECT origin, id, CAST(z[2] AS INTEGER) AS pos, z[1] AS sentence FROM (SELECT origin, id, unnest(list_zip(s, range(len(s)))) AS z FROM lists)""",
    "tokenize_terms": f"WITH {_TEXTS}, t AS (SELECT origin, id, {_terms('text')} AS terms FROM texts) SELECT origin, id, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(terms, ' ') AS terms FROM t",
    "bm25_tf_weights": f"WITH {_INDEX} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights",
    "bm25_query_terms": f"WITH t AS (SELECT item_id, list_sort(list_distinct({_terms('text')})) AS terms FROM benchmark) SELECT item_id, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS INTEGER) AS n_terms FROM t",
    "term_document_frequency": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_search_topk": f"WITH {_sparse(S.top_k)} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse",
    "page_quality": f"""WITH {_TEXTS}, pages_ AS (SELECT * FROM texts), {_QUALITY}
SELECT origin, id, CAST(chars AS INTEGER) AS chars, CASE WHEN j THEN round(orphan, 4) ELSE 0 END AS orphan_ratio, CAST(CASE WHEN j THEN vm ELSE 0 END AS INTEGER) AS virama_matra,
  CASE WHEN j THEN round(frequent, 4) ELSE 0 END AS i_matra_ratio, needs_ocr FROM quality""",
    "ocr_routing": f"""WITH pages_ AS (SELECT source, doc_id, text FROM documents UNION ALL SELECT 'literals', CAST(id AS BIGINT), text FROM (VALUES {LITERALS}) AS t(id, text)), {_QUALITY},
rates_by AS (SELECT source, avg(CAST(needs_ocr AS INTEGER)) AS rate FROM quality GROUP BY source)
SELECT source, doc_id, needs_ocr, needs_ocr OR rate > 0.3 AS to_ocr FROM quality JOIN rates_by USING (source)""",
    "sections": f"""WITH t AS (SELECT conv_id, turn, role, {_strip('text')} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, CAST(k AS INTEGER) AS section_no, role AS section, turn AS page, replace({_strip('b')}, chr(10), ' ') AS body
FROM (SELECT *, unnest(string_split(text, chr(10) || chr(10))) AS b FROM t) WHERE {_strip('b')} <> ''""",
    "chunks": _packed(f"SELECT conv_id, turn AS part, turn AS page, role AS section, {_sentences(_BODY)} AS s FROM conversations", "conv_id"),
    "contextual_text": """SELECT doc_id, md5(source || CASE WHEN lang = 'en' THEN '' ELSE ' | ' || lang END || chr(10) || text) AS embed_md5,
md5(CASE WHEN lang = 'en' THEN '' ELSE lang END || ' ' || text) AS index_md5 FROM documents""",
    "l2_normalized": f"""WITH raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL VALUES (-1, [3.0::DOUBLE, 4.0]), (-2, [0.0::DOUBLE, 0.0])), u AS (SELECT vec_id, {_UNIT} AS v FROM raw)
SELECT vec_id, CAST(z[2] AS INTEGER) AS "at", round(z[1], 6) AS x FROM (SELECT vec_id, unnest(list_zip(v, range(len(v)))) AS z FROM u)""",
    "dense_topk": f"WITH {_VECTORS}, {_dense('dense', S.prefetch_k)} SELECT item_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM dense",
    "rrf_fusion": f"""WITH {_VECTORS}, {_dense('one', S.prefetch_k)}, {_dense('two', S.prefetch_k, shift=1)}
SELECT item_id, vec_id, round(sum(1.0 / ({S.rrf_k} + CAST(rank AS DOUBLE))), 6) AS score FROM (SELECT item_id, vec_id, rank FROM one UNION ALL SELECT item_id, vec_id, rank FROM two) GROUP BY ALL""",
    "hybrid_search": _hybrid("true", "true"),
    "hybrid_search_filtered": _hybrid(*(f"{c} IN (SELECT doc_id FROM documents WHERE source IN {SOURCES})" for c in ("u.vec_id", "doc_id"))),
    "format_context": f"WITH {_sparse(S.top_k)} {_CONTEXT}",
    "rewrite_history": f"WITH {_BACK} SELECT conv_id, string_agg(role || ': ' || substr(text, 1, {S.message_chars}), chr(10) ORDER BY turn) AS history FROM back WHERE k <= {S.rewrite_messages} GROUP BY conv_id",
    "generation_history": f"WITH {_BACK} SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role, substr(text, 1, {S.message_chars}) AS content FROM back WHERE k <= {2 * S.max_history_turns}",
    "plan_fast_path": rf"""WITH q AS (SELECT 'conversations' AS origin, conv_id AS id, arg_max(text, turn) AS question, count(*) - 1 AS messages FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'literals', CAST(id AS BIGINT), text, id % 2 FROM (VALUES {LITERALS}) AS t(id, text)),
s AS (SELECT *, {_strip('question')} AS b FROM q),
d AS (SELECT *, coalesce(length(regexp_replace(b, '[^{_DEV_LETTERS}]', '', 'g')) / nullif(length(regexp_replace(b, '[^\p{{L}}\p{{M}}]', '', 'g')), 0) >= 0.3, false) AS dev FROM s)
SELECT origin, id, messages = 0 AND dev AS fast, b AS standalone, CASE WHEN dev THEN 'Hindi' ELSE 'English' END AS answer_language, false AS rewritten, b AS first_query FROM d""",
    "query_list_dedupe": f"""WITH r AS (SELECT CAST(id AS BIGINT) AS id, q, r FROM (VALUES {REWRITES}) AS t(id, q, r)
  UNION ALL SELECT item_id + 1000, text, text || '|' || lower(text) || '| |' || lower(text) || '|x' FROM benchmark),
e AS (SELECT id, q AS x, 0 AS pos FROM r UNION ALL SELECT id, trim(z[1]), CAST(z[2] AS BIGINT) FROM (SELECT id, unnest(list_zip(string_split(r, '|'), range(1, len(string_split(r, '|')) + 1))) AS z FROM r) WHERE trim(z[1]) <> ''),
f AS (SELECT id, x, min(pos) AS pos FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM f)
SELECT id, string_agg(x, '|' ORDER BY n) AS queries FROM k WHERE n <= {S.max_queries} GROUP BY id""",
    "answer_cache_key": rf"""SELECT conv_id, turn, sha256('[' || CAST(to_json(regexp_replace(trim(lower(text), ' ' || chr(10) || chr(9)), '\s+', ' ', 'g')) AS VARCHAR) || ', ["a", "d' || conv_id || '"], {S.top_k}]') AS key FROM conversations WHERE role = 'user'""",
    "content_doc_id": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents",
    "point_ids": f"""WITH h AS (SELECT doc_id, sha1(unhex('{POINT_NAMESPACE}') || encode(doc_id || ':' || doc_id % 7)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "catalog_stats": f"""SELECT conv_id AS doc_id, 'talk ' || conv_id AS title, 'talk' AS category, 'en' AS language, '-' AS source_file, CAST(count(*) AS INTEGER) AS pages,
CAST(count(*) FILTER (role = 'user') AS INTEGER) AS chunks, CAST(count(*) FILTER (length({_strip('text')}) < 40) AS INTEGER) AS ocr_pages, 'now' AS ingested_at FROM conversations GROUP BY conv_id""",
    "catalog_upsert": "SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'newer' ELSE 'old' END AS batch FROM documents",
    "catalog_by_title": "SELECT source AS title, count(*) AS chunks, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS place FROM documents GROUP BY source",
    "skip_ingested": "SELECT doc_id, lang FROM documents WHERE lang <> 'en'",
    "delete_doc": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, md5(text) AS md5 FROM documents WHERE source <> 'src0'",
    "rate_limit_decisions": _LIMITS,
    "streamed_limits": _LIMITS,
    "docx_headings": f"""WITH {_LINES},
t AS (SELECT CAST(-id AS BIGINT) AS id, 0 AS para, text, style FROM (VALUES {HEADINGS}) AS t(id, text, style) UNION ALL SELECT doc_id, para, text, style FROM lines)
SELECT id, CAST(para AS INTEGER) AS para, {_heading('text', 'style')} AS heading FROM t""",
    "docx_file_pages": rf"""WITH {_LINES},
p AS (SELECT doc_id, para, style, {_strip("regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g')")} AS bare, para % {LAID_OUT} = {LAID_OUT - 1} AS laid, CAST(para % {LAID_OUT} = {LAID_OUT - 1} AS INTEGER) + CAST(para % {BY_HAND} = {BY_HAND - 1} AS INTEGER) AS breaks FROM lines),
paged AS (SELECT *, 1 + coalesce(sum(breaks) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN laid AND bare <> '' THEN breaks ELSE 0 END AS page FROM p),
h AS (SELECT *, {_heading('bare', 'style')} AS heading FROM paged WHERE bare <> ''),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para) - row_number() OVER (PARTITION BY doc_id, heading ORDER BY para) AS run FROM h),
parts AS (SELECT doc_id, min(page) AS page, min(para) AS para, '## ' || string_agg(bare, ' — ' ORDER BY para) AS bare FROM runs WHERE heading GROUP BY doc_id, run UNION ALL SELECT doc_id, page, para, bare FROM runs WHERE NOT heading),
pages_ AS (SELECT doc_id, page, string_agg(bare, chr(10) || chr(10) ORDER BY para) AS text FROM parts GROUP BY doc_id, page)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, {_normal('text')} AS text, false AS ocr FROM pages_""",
    "watched_pages": f"""WITH files AS (SELECT string_agg(coalesce(text, '') || chr(12), '' ORDER BY doc_id, text) AS content FROM documents GROUP BY doc_id // {BOOK}),
f AS (SELECT DISTINCT substr(sha256(content), 1, 16) AS doc_id, string_split(content, chr(12)) AS l FROM files),
p AS (SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1))) AS z FROM f),
n AS (SELECT doc_id, CAST(z[2] AS INTEGER) AS page, {_normal('z[1]')} AS text FROM p WHERE {_strip('z[1]')} <> '')
SELECT doc_id, 'Watched' AS title, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS book_pages, page, false AS ocr, md5(text) AS md5 FROM n""",
    "answered_questions": f"""WITH {_sparse(S.top_k)}, context AS ({_CONTEXT}), {_BACK},
talk AS (SELECT conv_id AS item_id, count(*) AS n, sum(length(substr(text, 1, {S.message_chars}))) AS chars FROM back WHERE k <= {2 * S.max_history_turns} GROUP BY conv_id),
p AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Hindi' ELSE 'English' END AS language, context, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars, text FROM benchmark LEFT JOIN context USING (item_id) LEFT JOIN talk USING (item_id)),
q AS (SELECT *, length('Passages:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer in ' || language || '.') AS long FROM p)
SELECT item_id, CASE WHEN context IS NULL THEN CASE language WHEN 'Hindi' THEN '{NOTHING_FOUND['Hindi']}' ELSE '{NOTHING_FOUND['English']}' END WHEN long % 7 = 0 THEN ''
  ELSE CASE WHEN long % 2 = 0 THEN 'second' ELSE 'primary' END || ', after ' || chars || ' characters in ' || n || ' messages: ' || long END AS answer, CASE WHEN long % 7 = 0 THEN 'refused' ELSE '' END AS error FROM q""",
    "rewritten_plans": rf"""WITH {_BACK}, q AS (SELECT conv_id, {_strip('text')} AS q FROM back WHERE k = 1),
h AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || substr(text, 1, {S.message_chars}), chr(10) ORDER BY turn) FILTER (k <= {S.rewrite_messages} + 1) AS history FROM back WHERE k > 1 GROUP BY conv_id),
j AS (SELECT conv_id, q, coalesce(n, 0) AS n, coalesce(history, '(none)') AS history, {_devanagari('q')} AS dev FROM q LEFT JOIN h USING (conv_id)),
r AS (SELECT *, NOT (n = 0 AND dev) AND length(q) % 5 > 1 AS rewritten FROM j)
SELECT conv_id, rewritten, CASE WHEN rewritten THEN q || ' (' || length(history) || ')' ELSE q END AS standalone,
  CASE WHEN rewritten THEN q || ' (' || length(history) || ')|' || q || CASE WHEN {_strip('history')} = q THEN '' ELSE '|' || {_strip('history')} END ELSE q END AS queries,
  CASE WHEN rewritten THEN 'Hinglish' WHEN dev THEN 'Hindi' ELSE 'English' END AS answer_language FROM r""",
    "token_ids": f"""WITH {_TEXTS}, terms AS (SELECT DISTINCT unnest({_terms('text')}) AS term FROM texts),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT term, list_transform(range(length(hex(encode(term))) // 2), lambda i: CAST('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM terms)
SELECT term, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) & 2147483647 AS token_id FROM bytes, crc""",
    "document_chunks": _packed(_chunk_lists("documents"), "doc_id"),
    "dense_two_phase": f"""WITH {_VECTORS}, tops AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM unit),
codes AS (SELECT vec_id, list_transform(v, lambda x: round(x / CASE WHEN m = 0 THEN 1 ELSE m END * 127)) AS v FROM tops), coded AS (SELECT vec_id, {_UNIT} AS v FROM codes),
coarse AS (SELECT q.vec_id AS item_id, c.vec_id, round(list_inner_product(c.v, q.v), 6) AS score FROM benchmark b JOIN unit q ON q.vec_id = b.item_id CROSS JOIN coded c),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS r FROM coarse) WHERE r <= 100),
full_ AS (SELECT n.item_id, n.vec_id, round(list_inner_product(u.v, q.v), 6) AS score FROM near n JOIN unit u ON u.vec_id = n.vec_id JOIN unit q ON q.vec_id = n.item_id)
SELECT item_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM full_) WHERE rank <= 10""",
    "embedded_documents": """WITH c AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda l: CAST(length(lower(text)) - length(replace(lower(text), l, '')) AS DOUBLE)) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM c), u AS (SELECT doc_id, list_transform(v, lambda x: CAST(x / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT)) AS v FROM n)
SELECT doc_id, CAST(z[2] AS INTEGER) AS "at", round(CAST(z[1] AS DOUBLE), 6) AS x FROM (SELECT doc_id, unnest(list_zip(v, range(len(v)))) AS z FROM u)""",
    "text_file_pages": f"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS l FROM documents),
p AS (SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1))) AS z FROM l)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(z[2] AS INTEGER) AS page, {_normal('z[1]')} AS text, false AS ocr FROM p WHERE {_strip('z[1]')} <> ''""",
    "ocr_memo": f"""WITH pages_ AS (SELECT doc_id, text FROM documents), {_QUALITY},
r AS (SELECT doc_id, text, needs_ocr OR doc_id % 10 = 0 AS ocr FROM quality),
t AS (SELECT doc_id, ocr, CASE WHEN NOT ocr THEN {_normal('text')} WHEN doc_id % 20 = 0 THEN 'remembered ' || doc_id ELSE 'page read of ' || doc_id END AS text FROM r)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, text, ocr FROM t WHERE text <> ''""",
    "user_turns": f"""WITH t AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN ' ' || text ELSE text || '?' END AS original, CASE item_id % 3 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'hindi (Latin)' ELSE 'English' END AS language FROM benchmark)
SELECT item_id, 'Passages:' || chr(10) || chr(10) || '[1] ' || text || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || text || CASE WHEN {_strip('original')} <> {_strip('text')} THEN chr(10) || '(Asked as: ' || original || ')' ELSE '' END
  || chr(10) || chr(10) || 'Answer in ' || language || '.' AS turn, CASE WHEN lower(language) LIKE 'hindi%' THEN '{NOTHING_FOUND['Hindi']}' ELSE '{NOTHING_FOUND['English']}' END AS nothing FROM t""",
    "safe_names": rf"WITH {_TEXTS} SELECT origin, id, regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}.\-{_DEV} ]+', '_', 'g') AS name FROM texts",
}
