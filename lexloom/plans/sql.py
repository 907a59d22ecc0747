"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"
_FOLD = "strip_accents(lower({}))"

_CHUNKS = """
meta AS (
  SELECT id AS document_id, metadata['lang'] AS lang, string_split(metadata['tags'], ',') AS tags FROM search_document WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1),
ch AS (
  SELECT (row_number() OVER (PARTITION BY corpus ORDER BY id) - 1)::INT AS chunk_ix, * FROM (
    SELECT id, document_id, url, title, heading, content, CASE WHEN url LIKE 'http%' THEN 'pages' ELSE 'repo' END AS corpus,
      lang, metadata['version'] AS version, tags, try_cast(metadata['version'] AS DOUBLE) AS release
    FROM search_chunk LEFT JOIN meta USING (document_id) WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1))"""

_INDEX = f"""{_CHUNKS},
fields AS (
  SELECT corpus, chunk_ix, 'title' AS field, title AS t FROM ch UNION ALL
  SELECT corpus, chunk_ix, 'heading', heading FROM ch UNION ALL SELECT corpus, chunk_ix, 'body', content FROM ch),
tok AS (
  SELECT corpus, chunk_ix, field, {_FOLD.format("w")} AS term FROM (
    SELECT corpus, chunk_ix, field, unnest({_WORDS.format("t")}) AS w FROM fields) WHERE length({_FOLD.format("w")}) > 1),
post AS MATERIALIZED (
  SELECT corpus, term, chunk_ix, count(*) FILTER (WHERE field = 'title')::INT AS tf_title,
    count(*) FILTER (WHERE field = 'heading')::INT AS tf_heading, count(*) FILTER (WHERE field = 'body')::INT AS tf_body
  FROM tok GROUP BY ALL),
len AS (
  SELECT c.corpus, c.chunk_ix, coalesce(sum(tf_title), 0)::INT AS len_title, coalesce(sum(tf_heading), 0)::INT AS len_heading, coalesce(sum(tf_body), 0)::INT AS len_body
  FROM ch c LEFT JOIN post p ON p.corpus = c.corpus AND p.chunk_ix = c.chunk_ix GROUP BY ALL),
stats AS (
  SELECT corpus, count(*) AS chunk_count, avg(len_title)::FLOAT::DOUBLE AS avg_title, avg(len_heading)::FLOAT::DOUBLE AS avg_heading, avg(len_body)::FLOAT::DOUBLE AS avg_body
  FROM len GROUP BY corpus),
dict AS MATERIALIZED (SELECT corpus, term, count(*) AS df FROM post GROUP BY ALL),
qw AS (SELECT query_id, query_text AS text, {_WORDS.format("query_text")} AS w FROM search_query WHERE query_text IS NOT NULL),
qt AS (
  SELECT query_id, source_ix, {_FOLD.format("raw")} AS source, source_ix = n - 1 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]$') AS prefix FROM (
    SELECT query_id, text, len(w) AS n, unnest(w) AS raw, (generate_subscripts(w, 1) - 1)::INT AS source_ix FROM qw) WHERE length({_FOLD.format("raw")}) > 1)"""


def _expansion(budget: int) -> str:
    """exp(query_id, corpus, source_ix, source, term, df, kind, distance, boost, ord) from qt and dict."""
    return f"""
qc AS (SELECT qt.*, s.corpus FROM qt, (SELECT DISTINCT corpus FROM dict) s),
ex AS (SELECT q.query_id, q.corpus, q.source_ix, q.source, q.prefix, d.term, d.df, 'exact' AS kind, 0 AS distance FROM qc q JOIN dict d ON d.corpus = q.corpus AND d.term = q.source),
pr AS (
  SELECT query_id, corpus, source_ix, source, prefix, term, df, 'prefix' AS kind, 0 AS distance FROM (
    SELECT q.*, d.term, d.df, row_number() OVER (PARTITION BY q.query_id, q.corpus, q.source_ix ORDER BY d.df DESC, d.term) AS r,
      EXISTS (SELECT 1 FROM dict e WHERE e.corpus = q.corpus AND e.term = q.source) AS has
    FROM qc q JOIN dict d ON d.corpus = q.corpus AND starts_with(d.term, q.source) AND d.term <> q.source WHERE q.prefix)
  WHERE r <= {budget} - has::INT),
fz AS (
  SELECT query_id, corpus, source_ix, source, prefix, term, df, 'fuzzy' AS kind, distance FROM (
    SELECT q.*, d.term, d.df, levenshtein(q.source, d.term) AS distance, row_number() OVER (PARTITION BY q.query_id, q.corpus, q.source_ix ORDER BY levenshtein(q.source, d.term), d.df DESC, d.term) AS r
    FROM qc q JOIN dict d ON d.corpus = q.corpus AND left(d.term, 1) = left(q.source, 1) AND d.term <> q.source
    WHERE levenshtein(q.source, d.term) <= CASE WHEN length(q.source) >= 8 THEN 2 WHEN length(q.source) >= 4 THEN 1 ELSE 0 END
      AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = q.query_id AND ex.corpus = q.corpus AND ex.source_ix = q.source_ix)
      AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.query_id = q.query_id AND pr.corpus = q.corpus AND pr.source_ix = q.source_ix))
  WHERE r <= {budget}),
exp AS (
  SELECT *, CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'prefix' THEN 0.85::DOUBLE ELSE CASE distance WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END END AS boost,
    row_number() OVER (PARTITION BY query_id, corpus, source_ix ORDER BY CASE kind WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, distance, df DESC, term)::INT AS ord
  FROM (SELECT * FROM ex UNION ALL SELECT * FROM pr UNION ALL SELECT * FROM fz))"""


_BM25F = """
hits AS (
  SELECT e.query_id, e.corpus, p.chunk_ix, e.source_ix, e.term, e.source, e.kind, e.ord,
    ln(1 + (s.chunk_count - e.df + 0.5::DOUBLE) / (e.df + 0.5::DOUBLE)) * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wlen / greatest(1.0::DOUBLE, 2 * s.avg_title + 1.5::DOUBLE * s.avg_heading + s.avg_body))) * e.boost AS s
  FROM exp e JOIN (SELECT *, 2.0::DOUBLE * tf_title + 1.5::DOUBLE * tf_heading + tf_body AS wtf FROM post) p ON p.corpus = e.corpus AND p.term = e.term
  JOIN (SELECT *, 2.0::DOUBLE * len_title + 1.5::DOUBLE * len_heading + len_body AS wlen FROM len) l ON l.corpus = p.corpus AND l.chunk_ix = p.chunk_ix
  JOIN stats s ON s.corpus = e.corpus),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, corpus, chunk_ix, source_ix ORDER BY s DESC, ord) = 1),
lex AS (SELECT query_id, corpus, chunk_ix, sum(s) AS score FROM best GROUP BY ALL)"""

_LEX0, _LEX = f"WITH {_INDEX}, {_expansion(0)}, {_BM25F}", f"WITH {_INDEX}, {_expansion(16)}, {_BM25F}"


def _paged(where: str = "true", group: bool = True, offset: int = 0, limit: int = 10, corpora: str = "") -> str:
    """Result pages of exact fielded search over the built index."""
    best = """grp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id, corpus, document_id) AS matches,
      row_number() OVER (PARTITION BY query_id, corpus, document_id ORDER BY round(score, 9) DESC, chunk_ix) AS r FROM sc) WHERE r = 1)""" if group else "grp AS (SELECT *, 1 AS matches FROM sc)"  # fmt: skip
    only = f"WHERE corpus IN ({corpora})" if corpora else ""
    return f"""{_LEX0},
sc AS (
  SELECT l.query_id, l.corpus, l.chunk_ix, c.id, c.document_id, c.lang, c.tags, l.score / max(l.score) OVER (PARTITION BY l.query_id, l.corpus) AS score, ({where}) AS ok
  FROM (SELECT * FROM lex {only}) l JOIN ch c ON c.corpus = l.corpus AND c.chunk_ix = l.chunk_ix QUALIFY ok),
{best},
pg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, corpus, id)::INT AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM grp),
page AS (SELECT query_id, rank, corpus, chunk_ix, id, matches, total, round(score, 6) AS score, document_id FROM pg WHERE rank > {offset} AND rank <= {offset + limit})
SELECT query_id, rank, corpus, chunk_ix, id, matches, total, score FROM page"""


_WINDOWS = r"""SELECT doc_id, k::INT AS window_ix, (k * 150)::INT AS word_offset, sha256(array_to_string(w[k * 150 + 1 : k * 150 + 180], ' ')) AS content_sha
FROM (SELECT doc_id, w, unnest(range((1 + ceil(greatest(0, len(w) - 180) / 150.0))::BIGINT)) AS k
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)"""

# The stems step by step: plural, past forms, final y, derivational endings in order, the longest dropped ending, final e.
_ENDS = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_VERBS = "".join(f"WHEN a LIKE '%{e}' AND regexp_matches(left(a, length(a) - {len(e)}), '[aeiouy]') THEN left(a, length(a) - {len(e)}) " for e in ("ingly", "edly", "ing", "ed"))
_STEMS = rf"""WITH words AS (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents WHERE lang = 'en') WHERE length(word) > 1),
plurals AS (
  SELECT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN left(word, length(word) - 2)
    WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND regexp_matches(left(word, length(word) - 2), '[aeiouy]') THEN left(word, length(word) - 1) ELSE word END AS a FROM words),
cut AS (
  SELECT word, a, (a LIKE '%eedly' AND length(a) > 6) OR (a LIKE '%eed' AND length(a) > 4) AS ee, CASE {_VERBS} END AS v FROM plurals),
past AS (
  SELECT word, CASE WHEN ee AND a LIKE '%eedly' THEN left(a, length(a) - 3) WHEN ee THEN left(a, length(a) - 1) WHEN v IS NULL THEN a
    WHEN regexp_matches(v, '(at|bl|iz)$') THEN v || 'e'
    WHEN length(v) > 1 AND right(v, 1) = left(right(v, 2), 1) AND regexp_matches(v, '[^aeiou]$') AND NOT regexp_matches(v, '(ll|ss|zz)$') THEN left(v, length(v) - 1) ELSE v END AS b FROM cut),
ys AS (SELECT word, CASE WHEN regexp_matches(b, '[^aeiouy]y$') AND length(b) > 2 THEN left(b, length(b) - 1) || 'i' ELSE b END AS c FROM past),
derived AS (SELECT word, CASE {"".join(f"WHEN c LIKE '%{e}' AND length(c) >= {len(e) + 2} THEN left(c, length(c) - {len(e)}) || '{to}' " for e, to in _ENDS)} ELSE c END AS d FROM ys),
ended AS (SELECT word, d, length(regexp_extract(d, '(ement|ment|able|ible|ance|ence|ate|iti|ion|al|er|ic|ous|ive|ize)$', 1)) AS k FROM derived),
dropped AS (SELECT word, CASE WHEN length(d) > 4 AND k > 0 AND length(d) - k >= 3 THEN left(d, length(d) - k) ELSE d END AS e FROM ended)
SELECT word, CASE WHEN length(word) <= 3 THEN word WHEN length(e) > 4 AND e LIKE '%e' THEN left(e, length(e) - 1) ELSE e END AS stem FROM dropped"""

_SECTIONS = r"""
lines AS (
  SELECT doc_id, title, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (
    SELECT doc_id, title, regexp_split_to_array(text, '\r?\n') AS l FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(line, '^#{1,6}[ \t]+.+$') AS head, sum(regexp_matches(line, '^#{1,6}[ \t]+.+$')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM lines),
secs AS (
  SELECT doc_id, title, sec, max(CASE WHEN head THEN trim(regexp_extract(line, '^#{1,6}[ \t]+(.+)$', 1)) END) AS heading,
    trim(regexp_replace(string_agg(CASE WHEN head THEN NULL ELSE line END, ' ' ORDER BY n), '[ \t\n\x0B\f\r\x{a0}]+', ' ', 'g')) AS section
  FROM marked GROUP BY ALL),
titles AS (SELECT doc_id, list_extract(list(heading ORDER BY sec) FILTER (WHERE section <> ''), 1) AS first FROM secs GROUP BY doc_id)"""

_VEC = """
good AS (
  SELECT vec_id, corpus, chunk AS chunk_ix, written_at, vector_values::DOUBLE[] AS v FROM decoded_vector_v2
  WHERE vec_id IS NOT NULL AND len(vector_values) = dimensions AND len(list_filter(vector_values, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector_values, lambda x: x <> 0)) > 0),
vec AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY written_at DESC NULLS LAST) = 1),
cos AS (
  SELECT q.query_id, v.corpus, v.chunk_ix, list_cosine_similarity(v.v, q.query_values::DOUBLE[]) AS cosine
  FROM vec v JOIN search_query q ON q.corpus = v.corpus AND len(q.query_values) = len(v.v))"""


def _run(profile: str) -> str:
    return f"""(SELECT query_id, corpus || '#' || chunk AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus, chunk)::INT AS rank FROM (
  SELECT query_id, corpus, chunk, score FROM lexical_score_v2 WHERE profile = '{profile}' AND query_id IS NOT NULL AND chunk IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, corpus, chunk ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) = 1) WHERE score IS NOT NULL)"""


_EVAL = f"""
run AS {_run("default")},
qrels AS (SELECT query_id, doc_id, greatest(0, 4 - rank) AS rel FROM {_run("title_boost")} WHERE rank <= 6),
judged AS (SELECT query_id, count(*) FILTER (WHERE rel > 0) AS relevant FROM qrels GROUP BY 1),
hit AS (
  SELECT r.query_id, r.rank, coalesce(q.rel, 0) AS rel, sum((coalesce(q.rel, 0) > 0)::INT) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS hits
  FROM run r SEMI JOIN judged j ON j.query_id = r.query_id LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE r.rank <= 10),
ideal AS (SELECT query_id, sum(rel / log2(r + 1)) AS ideal FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM qrels) WHERE r <= 10 GROUP BY 1),
got AS (
  SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS precisions, count(*) FILTER (WHERE rel > 0) AS found,
    min(rank) FILTER (WHERE rel > 0) AS first, sum(CASE WHEN rel > 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS bdcg FROM hit GROUP BY 1),
graded AS (
  SELECT j.query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END AS ndcg, CASE WHEN relevant > 0 THEN coalesce(precisions, 0) / relevant END AS ap,
    CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant END AS recall, coalesce(found, 0) / 10 AS "precision", coalesce(1 / first, 0) AS rr
  FROM judged j LEFT JOIN ideal i ON i.query_id = j.query_id LEFT JOIN got g ON g.query_id = j.query_id)"""

_RESULTS = """
res AS (SELECT o_orderpriority AS dataset, o_orderstatus AS engine, count(*) AS queries, sum(o_totalprice) AS query_ms, avg(o_totalprice) / 1e6 AS ndcg, count(*) % 7 <> 0 AS completed FROM orders GROUP BY ALL)"""

_CACHE = """
cache AS (
  SELECT 'p' || (doc_id % 3) AS provider, left(sha256('p' || chr(0) || coalesce(text, '')), 16) AS key, 64 AS bytes, ingested_at AS accessed_at FROM documents WHERE doc_id % 2 = 0),
held AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY provider, key ORDER BY accessed_at DESC NULLS LAST) = 1)"""

_V1 = rf"""{_CHUNKS},
w1 AS (SELECT corpus, chunk_ix, list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(heading, '') || ' ' || coalesce(content, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM ch),
p1 AS (SELECT corpus, chunk_ix, term, count(*) AS tf FROM (SELECT corpus, chunk_ix, unnest(w) AS term FROM w1) GROUP BY ALL),
d1 AS (SELECT corpus, term, count(*) AS df FROM p1 GROUP BY ALL),
s1 AS (SELECT corpus, count(*) AS n, avg(len(w)) AS average FROM w1 GROUP BY ALL),
q1 AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) AS term FROM search_query) WHERE length(term) > 1)"""


def _filter(where: str) -> str:
    return f"WITH {_CHUNKS} SELECT corpus, chunk_ix, id FROM ch WHERE {where}"


_ASKED = f"SELECT query_id, query_text AS text, {_WORDS.format('query_text')} AS w FROM search_query WHERE query_text IS NOT NULL"
assert _ASKED in _INDEX


def _asking(rows: str) -> str:
    """The index' tables with the queries of ``rows`` (query_id, text) in place of the stored ones."""
    return _INDEX.replace(_ASKED, f"SELECT query_id, text, {_WORDS.format('text')} AS w FROM ({rows})")


_TYPOS = f"""WITH {_asking("SELECT DISTINCT term AS query_id, left(term, 2) || substring(term, 4, 1) || substring(term, 3, 1) || substring(term, 5) || '.' AS text FROM dict WHERE length(term) >= 8")},
{_expansion(4)}
SELECT query_id AS meant, corpus, source, term, distance::INT AS distance, ord FROM exp WHERE kind = 'fuzzy'"""

_SHARDS = f"""WITH RECURSIVE {_CHUNKS},
c AS MATERIALIZED (SELECT corpus, chunk_ix, coalesce(octet_length(encode(content)), 0)::BIGINT AS bytes FROM ch),
g AS (
  SELECT corpus, chunk_ix, 0 AS shard, bytes, bytes AS held FROM c WHERE chunk_ix = 0
  UNION ALL
  SELECT c.corpus, c.chunk_ix, g.shard + (g.held > 0 AND g.held + c.bytes > 131072)::INT, c.bytes, CASE WHEN g.held > 0 AND g.held + c.bytes > 131072 THEN c.bytes ELSE g.held + c.bytes END
  FROM g JOIN c ON c.corpus = g.corpus AND c.chunk_ix = g.chunk_ix + 1)
SELECT corpus, shard, count(*) AS chunks, sum(bytes)::BIGINT AS bytes FROM g GROUP BY ALL"""

_BOTH = rf"""WITH {_CHUNKS},
w AS (SELECT corpus, chunk_ix, list_filter(regexp_extract_all(lower(coalesce(content, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM ch),
p AS (SELECT corpus, chunk_ix, term, count(*) AS tf FROM (SELECT corpus, chunk_ix, unnest(w) AS term FROM w) GROUP BY ALL),
d AS (SELECT corpus, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT corpus, count(*) AS n, avg(len(w)) AS average FROM w GROUP BY ALL),
q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) AS term FROM search_query) WHERE length(term) > 1),
hits AS (
  SELECT q.query_id, p.corpus, p.chunk_ix, ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE AS top, p.tf AS tf, len(w.w) AS l, greatest(s.average, 1) AS a1, greatest(s.average::FLOAT::DOUBLE, 1) AS a2
  FROM q JOIN p ON p.term = q.term JOIN d ON d.corpus = p.corpus AND d.term = p.term JOIN s ON s.corpus = p.corpus JOIN w ON w.corpus = p.corpus AND w.chunk_ix = p.chunk_ix)
SELECT query_id, corpus, chunk_ix, round(sum(top / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a1))), 6) AS score_v1, round(sum(top / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a2))), 6) AS score_v2
FROM hits GROUP BY ALL"""

_CONFIGURED = rf"""WITH {_SECTIONS},
kept AS (
  SELECT doc_id, project, 'english' AS corpus, 180 AS most, 150 AS step FROM documents WHERE lang = 'en' AND doc_id % 10 <> 7
  UNION ALL SELECT doc_id, NULL, 'others', 60, 50 FROM documents WHERE lang <> 'en' OR lang IS NULL),
cut AS (
  SELECT k.corpus, k.project, 1 + ceil(greatest(0, n - most) / step::DOUBLE)::BIGINT AS windows FROM kept k
  JOIN (SELECT doc_id, len(list_filter(regexp_split_to_array(section, '\s+'), lambda x: x <> '')) AS n FROM secs WHERE section <> '') x ON x.doc_id = k.doc_id WHERE n > 0),
made AS (SELECT corpus, sum(windows)::BIGINT AS chunks, count(DISTINCT project) AS projects FROM cut GROUP BY corpus)
SELECT d.corpus, d.documents, coalesce(m.chunks, 0) AS chunks, coalesce(m.chunks, 0) AS indexed, coalesce(m.projects, 0) AS projects, CASE d.corpus WHEN 'others' THEN coalesce(m.chunks, 0) ELSE 0 END AS vectors
FROM (SELECT corpus, count(*) AS documents FROM kept GROUP BY corpus) d LEFT JOIN made m ON m.corpus = d.corpus"""


def _candidate(name: str, title: float, heading: float, body: float, grouped: bool) -> str:
    weighted = lambda x: f"{title}::DOUBLE * {x}_title + {heading}::DOUBLE * {x}_heading + {body}::DOUBLE * {x}_body"
    scored = _BM25F.replace("2.0::DOUBLE * tf_title + 1.5::DOUBLE * tf_heading + tf_body", weighted("tf")).replace("2.0::DOUBLE * len_title + 1.5::DOUBLE * len_heading + len_body", weighted("len")).replace("2 * s.avg_title + 1.5::DOUBLE * s.avg_heading + s.avg_body", weighted("s.avg"))
    once = "QUALIFY row_number() OVER (PARTITION BY query_id, corpus, document_id ORDER BY round(score, 9) DESC, chunk_ix) = 1" if grouped else ""
    return f"""SELECT '{name}' AS candidate, 'lexical' AS mode, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM (
WITH {scored},
sc AS (SELECT l.query_id, l.corpus, l.chunk_ix, c.id, c.document_id, l.score / max(l.score) OVER (PARTITION BY l.query_id, l.corpus) AS score FROM lex l JOIN ch c ON c.corpus = l.corpus AND c.chunk_ix = l.chunk_ix),
grp AS (SELECT * FROM sc {once}),
top AS (SELECT query_id, document_id, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, corpus, id) AS rank FROM grp) WHERE rank <= 10 GROUP BY ALL),
got AS (SELECT j.query_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM judged j JOIN top t ON t.query_id = j.query_id AND t.document_id = j.document_id GROUP BY ALL)
SELECT w.query_id, coalesce(h, 0) / n AS recall, coalesce(1 / first, 0) AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda r: 1 / log2(r + 1))) AS ndcg
FROM (SELECT query_id, count(*) AS n FROM judged GROUP BY query_id) w LEFT JOIN got g ON g.query_id = w.query_id)"""


_CANDIDATES = f"""WITH {_asking("SELECT DISTINCT title AS query_id, title || ' ' AS text FROM ch WHERE trim(title) <> ''")}, {_expansion(0)},
judged AS MATERIALIZED (SELECT DISTINCT title AS query_id, document_id FROM ch WHERE trim(title) <> '')
{_candidate("default", 2, 1.5, 1, True)} UNION ALL {_candidate("titles", 5, 1, 0.5, True)} UNION ALL {_candidate("chunks", 2, 1.5, 1, False)}"""

_INCREMENTAL = rf"""WITH {_SECTIONS},
named AS (
  SELECT s.doc_id, coalesce(nullif(CASE WHEN s.doc_id % 3 < 2 THEN 'Again ' || coalesce(s.title, 'untitled') ELSE s.title END, ''), first, '/doc/' || s.doc_id) AS title, heading,
    list_filter(regexp_split_to_array(section, '\s+'), lambda x: x <> '') AS w FROM secs s JOIN titles t ON t.doc_id = s.doc_id WHERE section <> ''),
cut AS (
  SELECT doc_id, title, heading, array_to_string(w[k * 150 + 1 : k * 150 + 180], ' ') AS content
  FROM (SELECT *, unnest(range((1 + ceil(greatest(0, len(w) - 180) / 150.0))::BIGINT)) AS k FROM named WHERE len(w) > 0)),
fields AS (SELECT doc_id, 'title' AS field, title AS t FROM cut UNION ALL SELECT doc_id, 'heading', heading FROM cut UNION ALL SELECT doc_id, 'body', content FROM cut),
words AS (SELECT doc_id, field, {_FOLD.format("w")} AS term FROM (SELECT doc_id, field, unnest({_WORDS.format("t")}) AS w FROM fields))
SELECT doc_id::VARCHAR AS document_id, term, count(*) FILTER (WHERE field = 'title')::INT AS tf_title, count(*) FILTER (WHERE field = 'heading')::INT AS tf_heading, count(*) FILTER (WHERE field = 'body')::INT AS tf_body
FROM words WHERE length(term) > 1 GROUP BY ALL"""


SQL: dict[str, str] = {
    "flagship": _paged(),
    "index_round_trip": _paged(),
    "group_none": _paged(group=False),
    "page_offset_limit": _paged(group=False, offset=3, limit=4),
    "corpus_subset": _paged(corpora="'repo'"),
    "search_where": _paged(where="coalesce(c.lang = 'en' AND c.release >= 2 AND c.release < 4 AND list_has_any(c.tags, ['cache', 'query', 'index']), false)"),
    "group_expanded": _paged().rsplit("SELECT query_id, rank", 1)[0] + """SELECT p.query_id, p.rank, p.corpus, p.document_id, p.matches, string_agg(s.id, ' ' ORDER BY round(s.score, 9) DESC, s.chunk_ix) AS chunk_ids
FROM page p JOIN sc s ON s.query_id = p.query_id AND s.corpus = p.corpus AND s.document_id IS NOT DISTINCT FROM p.document_id GROUP BY ALL""",
    "hydrated": _paged(limit=3).rsplit("SELECT query_id, rank", 1)[0] + "SELECT p.query_id, p.rank, p.id, sha256(c.content) AS content_sha FROM page p JOIN ch c ON c.corpus = p.corpus AND c.chunk_ix = p.chunk_ix",
    "facets_query": _paged().rsplit("SELECT query_id, rank", 1)[0] + """SELECT query_id, field, value, count(*) AS number FROM (
  SELECT query_id, 'lang' AS field, coalesce(lang, 'null') AS value FROM grp
  UNION ALL SELECT query_id, 'tags', unnest(CASE WHEN tags IS NULL THEN ['null'] ELSE list_distinct(tags) END) FROM grp) GROUP BY ALL""",
    "tokenize_count": r"SELECT doc_id, len(list_filter(coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []), lambda x: length(x) > 1))::INT AS n_tokens FROM documents",
    "fold_terms": rf"SELECT raw, {_FOLD.format('raw')} AS folded FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS raw FROM documents)",
    "clean_titles": r"SELECT doc_id, trim(regexp_replace(title, '[ \t\n\x0B\f\r\x{a0}]+', ' ', 'g')) AS title FROM documents",
    "route_filter": "SELECT DISTINCT id, url FROM search_document WHERE (url LIKE '/guides/%' OR url = '/guides' OR regexp_full_match(url, '/howto/[^/]*')) AND NOT regexp_full_match(url, '/guides/how-to-[^/]*')",
    "stem_terms": _STEMS,
    "text_sections": f"""WITH {_SECTIONS}
SELECT doc_id::VARCHAR AS id, coalesce(nullif(title, ''), first, '/doc/' || doc_id) AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section_ix, heading, sha256(section) AS section_sha
FROM secs JOIN titles USING (doc_id) WHERE section <> ''""",
    "chunk_windows": _WINDOWS,
    "chunk_ids": "SELECT document_id, heading, left(sha256(document_id || chr(0) || coalesce(heading, '') || chr(0) || '0'), 16) AS chunk_id FROM (SELECT DISTINCT document_id, heading FROM search_chunk WHERE document_id IS NOT NULL)",
    "document_ordinals": f"WITH {_CHUNKS} SELECT corpus, document_id, (row_number() OVER (PARTITION BY corpus ORDER BY f) - 1)::INT AS document_ix FROM (SELECT corpus, document_id, min(chunk_ix) AS f FROM ch GROUP BY ALL)",
    "postings": f"WITH {_INDEX} SELECT * FROM post",
    "dictionary_df": f"WITH {_INDEX} SELECT * FROM dict",
    "field_lengths": f"WITH {_INDEX} SELECT * FROM len",
    "corpus_stats": f"WITH {_INDEX} SELECT corpus, chunk_count, round(avg_title, 6) AS avg_title, round(avg_heading, 6) AS avg_heading, round(avg_body, 6) AS avg_body FROM stats",
    "index_checks": f"""WITH {_INDEX}
SELECT 'posting without occurrence' AS fault, count(*) AS number FROM post WHERE tf_title + tf_heading + tf_body <= 0
UNION ALL SELECT 'repeated posting', count(*) FROM (SELECT 1 FROM post GROUP BY corpus, term, chunk_ix HAVING count(*) > 1)
UNION ALL SELECT 'posting of an unknown chunk', count(*) FROM post p WHERE NOT EXISTS (SELECT 1 FROM len l WHERE l.corpus = p.corpus AND l.chunk_ix = p.chunk_ix)
UNION ALL SELECT 'document frequency unlike postings', count(*) FROM (SELECT corpus, term, count(*) AS df FROM post GROUP BY ALL) p FULL JOIN dict d USING (corpus, term) WHERE p.df IS DISTINCT FROM d.df
UNION ALL SELECT 'term without text', count(*) FROM dict WHERE coalesce(length(term), 0) < 1
UNION ALL SELECT 'repeated term', count(*) FROM (SELECT 1 FROM dict GROUP BY corpus, term HAVING count(*) > 1)
UNION ALL SELECT 'posting with a negative frequency', count(*) FROM post WHERE least(tf_title, tf_heading, tf_body) < 0
UNION ALL SELECT 'repeated chunk', count(*) FROM (SELECT 1 FROM ch GROUP BY corpus, chunk_ix HAVING count(*) > 1)""",
    "build_counts": f"WITH {_CHUNKS} SELECT corpus, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM ch GROUP BY corpus",
    "bm25_v1": f"""WITH {_V1}
SELECT q.query_id, p.corpus, p.chunk_ix, round(sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.w) / greatest(s.average, 1)))), 6) AS score,
  string_agg(p.term, ' ' ORDER BY p.term) AS terms
FROM q1 q JOIN p1 p ON p.term = q.term JOIN d1 d ON d.corpus = p.corpus AND d.term = p.term JOIN s1 s ON s.corpus = p.corpus JOIN w1 w ON w.corpus = p.corpus AND w.chunk_ix = p.chunk_ix GROUP BY ALL""",
    "expand_terms": f"WITH {_INDEX}, {_expansion(16)} SELECT query_id, corpus, source_ix, source, term, kind, distance::INT AS distance, boost, ord FROM exp",
    "bm25f_exact": f"{_LEX0} SELECT query_id, corpus, chunk_ix, round(score, 6) AS score FROM lex",
    "bm25f_expanded": f"{_LEX} SELECT query_id, corpus, chunk_ix, round(score, 6) AS score FROM lex",
    "bm25f_matched_terms": f"{_LEX} SELECT query_id, corpus, chunk_ix, source_ix, term, source, kind FROM best",
    "bm25f_stored": f"""WITH raw AS (
  SELECT corpus, term, chunk AS chunk_ix, greatest(0, coalesce(frequencies[1], 0)) AS tf_title, greatest(0, coalesce(frequencies[2], 0)) AS tf_heading, greatest(0, coalesce(frequencies[3], 0)) AS tf_body, ingested_at
  FROM lexical_posting_v2 WHERE corpus IS NOT NULL AND term IS NOT NULL AND chunk IS NOT NULL),
post AS (SELECT * FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY corpus, term, chunk_ix ORDER BY ingested_at DESC NULLS LAST, tf_title DESC, tf_heading DESC, tf_body DESC) = 1) WHERE tf_title + tf_heading + tf_body > 0),
len AS (SELECT corpus, chunk_ix, sum(tf_title) AS len_title, sum(tf_heading) AS len_heading, sum(tf_body) AS len_body FROM post GROUP BY ALL),
stats AS (SELECT corpus, count(*) AS chunk_count, avg(len_title)::FLOAT::DOUBLE AS avg_title, avg(len_heading)::FLOAT::DOUBLE AS avg_heading, avg(len_body)::FLOAT::DOUBLE AS avg_body FROM len GROUP BY corpus),
dict AS (SELECT corpus, term, count(*) AS df FROM post GROUP BY ALL),
exp AS (
  SELECT query_id, d.corpus, source_ix, d.term, d.term AS source, 'exact' AS kind, 1 AS ord, d.df, 1.0::DOUBLE AS boost FROM (
    SELECT query_id, corpus, generate_subscripts(w, 1) AS source_ix, {_FOLD.format("unnest(w)")} AS term FROM (SELECT query_id, corpus, {_WORDS.format("query_text")} AS w FROM search_query WHERE query_text IS NOT NULL)) q
  JOIN dict d ON d.corpus = q.corpus AND d.term = q.term WHERE length(q.term) > 1), {_BM25F}
SELECT query_id, corpus, chunk_ix, round(score, 6) AS score FROM lex""",
    "facets_global": f"""WITH {_CHUNKS} SELECT corpus, field, value, count(*) AS number FROM (
  SELECT corpus, 'lang' AS field, lang AS value FROM ch UNION ALL SELECT corpus, 'tags', unnest(list_distinct(tags)) FROM ch) WHERE value IS NOT NULL GROUP BY ALL""",
    "filter_eq": _filter("lang = 'en'"),
    "filter_in_array": _filter("list_has_any(tags, ['cache', 'query'])"),
    "filter_range": _filter("release BETWEEN 1.5 AND 3"),
    "filter_exists": _filter("tags IS NULL"),
    "filter_null": _filter("lang IS NULL"),
    "filter_orders": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "cosine_all": f"WITH {_VEC} SELECT query_id, corpus, chunk_ix, round(cosine, 6) AS cosine FROM cos",
    "cosine_topk": f"WITH {_VEC} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, corpus, chunk_ix)::INT AS rank, corpus, chunk_ix, round(cosine, 6) AS cosine FROM cos QUALIFY rank <= 10",
    "quantize_int8": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127 AS scale FROM embeddings),
q AS (SELECT vec_id, scale, list_transform(v, lambda x: greatest(-127, least(127, floor(x / scale + 0.5::DOUBLE)))::INT) AS q FROM s)
SELECT vec_id, round(scale, 6) AS scale, list_sum(q)::INT AS total, list_min(q) AS least, list_max(q) AS most FROM q""",
    "cosine_int8": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT) AS u FROM embeddings),
s AS (SELECT *, (list_max(list_transform(u, lambda x: abs(x)))::DOUBLE / 127)::FLOAT::DOUBLE AS scale FROM u)
SELECT vec_id, round(list_cosine_similarity(v, list_transform(u, lambda x: greatest(-127, least(127, floor(x::DOUBLE / scale + 0.5::DOUBLE)))::DOUBLE)), 4) AS cosine FROM s""",
    "hybrid_blend": f"""WITH {_VEC},
s AS (SELECT query_id, corpus, chunk AS chunk_ix, score AS lex FROM lexical_score_v2 WHERE profile = 'default' AND query_id IS NOT NULL AND corpus IS NOT NULL AND chunk IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, corpus, chunk ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) = 1),
t AS (SELECT *, max(lex) OVER (PARTITION BY query_id, corpus) AS top FROM s WHERE lex IS NOT NULL)
SELECT query_id, corpus, chunk_ix, score FROM (
  SELECT t.query_id, t.corpus, t.chunk_ix, round(CASE WHEN c.cosine IS NULL THEN lex / top ELSE lex / top * 0.5::DOUBLE + (c.cosine + 1) / 2 * 0.5::DOUBLE END, 6) AS score
  FROM t LEFT JOIN cos c ON c.query_id = t.query_id AND c.corpus = t.corpus AND c.chunk_ix = t.chunk_ix WHERE top > 0) WHERE score > 0""",
    "cache_hits_misses": """WITH k AS (SELECT doc_id, left(sha256('p' || chr(0) || coalesce(text, '')), 16) AS key FROM documents), h AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)
SELECT count(*) AS texts, count(h.key) AS hits, count(*) - count(h.key) AS misses, count(DISTINCT CASE WHEN h.key IS NULL THEN k.key END) AS embedded FROM k LEFT JOIN h ON h.key = k.key""",
    "cache_stats": f"WITH {_CACHE} SELECT coalesce(provider, 'all') AS provider, count(*) AS entries, sum(bytes)::BIGINT AS bytes, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') AS last_used FROM held GROUP BY ROLLUP (provider)",
    "cache_evict_lru": f"""WITH {_CACHE}
SELECT provider, key FROM (SELECT provider, key, bytes, sum(bytes) OVER (ORDER BY accessed_at NULLS FIRST, provider, key ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes) OVER () AS total FROM held) WHERE total - (upto - bytes) <= 6400""",
    "metric_graded": f'WITH {_EVAL} SELECT query_id, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(rr, 6) AS rr FROM graded',
    "metric_binary": f"""WITH {_EVAL}
SELECT j.query_id, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(bdcg, 0) / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg
FROM judged j LEFT JOIN got g ON g.query_id = j.query_id WHERE relevant > 0""",
    "metric_means": f'WITH {_EVAL} SELECT count(*) AS queries, round(avg(coalesce(ndcg, 0)), 6) AS ndcg, round(avg(coalesce(ap, 0)), 6) AS ap, round(avg(coalesce(recall, 0)), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(rr), 6) AS rr FROM graded',
    "dedup_ranked_ids": f"""WITH run AS {_run("default")}, g AS (SELECT query_id, split_part(doc_id, '#', 1) || '#' || (split_part(doc_id, '#', 2)::BIGINT // 8) AS doc_id, min(rank) AS r FROM run GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id)::INT AS rank, doc_id FROM g QUALIFY rank <= 20""",
    "macro_weighted": f"""WITH {_RESULTS} SELECT engine, count(*) AS datasets, round(avg(ndcg), 6) AS ndcg, round(sum(query_ms) FILTER (WHERE completed) / sum(queries) FILTER (WHERE completed), 3) AS ms_per_query FROM res GROUP BY engine""",
    "quality_gates": f"""WITH {_RESULTS}, refs AS (SELECT dataset, max(ndcg) + 0.145::DOUBLE AS reference FROM res GROUP BY 1), mine AS (SELECT f.dataset, f.reference, r.ndcg, r.completed FROM refs f LEFT JOIN res r ON r.dataset = f.dataset AND r.engine = 'F')
SELECT dataset, 'F' AS engine, 'missing' AS kind, NULL::DOUBLE AS actual, NULL::DOUBLE AS minimum FROM mine WHERE NOT coalesce(completed, false)
UNION ALL SELECT dataset, 'F', 'sanity', round(ndcg, 6), round(reference - 0.15::DOUBLE, 6) FROM mine WHERE completed AND ndcg < reference - 0.15::DOUBLE
UNION ALL SELECT dataset, engine, 'regression', round(ndcg, 6), round(ndcg + 0.05::DOUBLE - 0.02::DOUBLE, 6) FROM res WHERE engine = 'P'""",
    "latency_percentile": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "run_compare": f"""WITH {_RESULTS}, c AS (SELECT dataset AS candidate, engine AS mode, CASE engine WHEN 'O' THEN -ndcg WHEN 'P' THEN ndcg * 0.5::DOUBLE - ndcg ELSE ndcg * 1.01::DOUBLE - ndcg END AS change, CASE engine WHEN 'O' THEN -ndcg / 2 ELSE 0 END AS rc, CASE engine WHEN 'O' THEN -ndcg / 3 ELSE 0 END AS rrc FROM res)
SELECT candidate, mode, round(change, 6) AS ndcg_change, round(rc, 6) AS recall_change, round(rrc, 6) AS rr_change, change >= -0.01::DOUBLE AS passed FROM c""",
    "salient_terms": rf"""WITH {_V1}, df AS (SELECT corpus, term, count(*) AS df FROM p1 GROUP BY ALL),
own AS (
  SELECT corpus, chunk_ix, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(content, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4 AND NOT list_contains(h, x)))) AS term FROM (
    SELECT *, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(heading, '')), '[\p{{L}}\p{{N}}]+') AS h FROM ch))
SELECT o.corpus, o.chunk_ix, o.term, round(ln(1 + s.n / d.df), 6) AS salience FROM own o JOIN df d ON d.corpus = o.corpus AND d.term = o.term JOIN s1 s ON s.corpus = o.corpus
QUALIFY row_number() OVER (PARTITION BY o.corpus, o.chunk_ix ORDER BY d.df, o.term) = 1""",
    "expand_typos": _TYPOS,
    "content_shards": _SHARDS,
    "embed_hash_provider": r"SELECT doc_id::VARCHAR AS key, 64 AS dimensions, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "v1_v2_same_ranking": _BOTH,
    "build_from_config": _CONFIGURED,
    "run_candidates": _CANDIDATES,
    "incremental_rebuild": _INCREMENTAL,
}

SQL["index_v1_round_trip"] = SQL["bm25_v1"]
