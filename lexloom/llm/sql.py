"""DuckDB counterparts of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_POSTINGS = """
rows_of AS (
  SELECT 'v1' AS kind, corpus, document_index AS record_ix, term, coalesce(term_frequency, 0)::BIGINT AS frequency, ingested_at FROM lexical_posting_v1
  UNION ALL
  SELECT 'v2', corpus, chunk, term, coalesce(list_sum(list_transform(frequencies, lambda x: coalesce(x, 0))), 0)::BIGINT, ingested_at FROM lexical_posting_v2),
folded AS (
  SELECT kind, corpus, record_ix, trim(strip_accents(lower(term))) AS term, frequency, ingested_at FROM rows_of
  WHERE corpus IS NOT NULL AND record_ix IS NOT NULL AND term IS NOT NULL AND trim(term) <> ''),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kind, corpus, record_ix, term ORDER BY ingested_at DESC NULLS LAST, frequency DESC) AS nth FROM folded),
postings AS (SELECT kind, corpus, record_ix, term, frequency FROM ranked WHERE nth = 1 AND frequency > 0),
size AS (SELECT count(*) AS n FROM (SELECT DISTINCT kind, corpus, record_ix FROM postings)),
terms AS (SELECT term, sum(frequency)::BIGINT AS occurrences, count(*) AS records FROM postings GROUP BY term)"""

_MARKED = f"""WITH {_POSTINGS}
SELECT term, occurrences, records, records::DOUBLE / n AS record_share,
  CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * n THEN 'common' ELSE 'useful' END AS mark
FROM terms, size"""

_VECTORS = """
good AS (
  SELECT vec_id, corpus, chunk, dimensions, written_at, list_transform(vector_values, lambda x: x::DOUBLE) AS v FROM decoded_vector_v2
  WHERE vec_id IS NOT NULL AND len(vector_values) = dimensions
    AND len(list_filter(vector_values, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector_values, lambda x: x <> 0)) > 0),
vecs AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY written_at DESC NULLS LAST) = 1)"""

_ORDERED = f"""WITH {_VECTORS},
wide AS (
  SELECT query_id, corpus, chunk,
    arg_max_null(score, scored_at) FILTER (WHERE profile = 'default') AS a, arg_max_null(score, scored_at) FILTER (WHERE profile = 'title_boost') AS b
  FROM lexical_score_v2 WHERE query_id IS NOT NULL AND corpus IS NOT NULL AND chunk IS NOT NULL GROUP BY ALL),
own AS (SELECT * FROM vecs QUALIFY row_number() OVER (PARTITION BY corpus, chunk ORDER BY written_at DESC NULLS LAST, vec_id DESC) = 1),
cands AS (
  SELECT w.query_id, w.corpus, w.chunk, a, b,
    CASE WHEN len(q.query_values) = len(o.v) THEN list_cosine_similarity(q.query_values::DOUBLE[], o.v) END AS c
  FROM wide w LEFT JOIN search_query q USING (query_id) LEFT JOIN own o ON o.corpus = w.corpus AND o.chunk = w.chunk),
long AS (
  SELECT query_id, corpus, chunk, 1 AS by_, coalesce(a, '-infinity'::DOUBLE) AS v FROM cands
  UNION ALL SELECT query_id, corpus, chunk, 2, coalesce(b, '-infinity'::DOUBLE) FROM cands
  UNION ALL SELECT query_id, corpus, chunk, 3, coalesce(c, '-infinity'::DOUBLE) FROM cands),
placed AS (
  SELECT *, rank() OVER (PARTITION BY query_id, by_ ORDER BY v) + (count(*) OVER (PARTITION BY query_id, by_, v) - 1) / 2.0::DOUBLE AS r,
    count(*) OVER (PARTITION BY query_id, by_) AS n FROM long),
pairs AS (
  SELECT p.query_id, p.corpus, p.chunk, p.by_, p.n, CASE WHEN p.n > 1 THEN (p.r - o.r) / (p.n - 1) ELSE 0 END AS d
  FROM placed p JOIN placed o ON o.query_id = p.query_id AND o.by_ = p.by_),
flows AS (
  SELECT query_id, corpus, chunk, by_, sum(sign(d) * least(1, greatest(0, (abs(d) - 0.05::DOUBLE) / 0.45::DOUBLE))) / greatest(any_value(n) - 1, 1) AS f FROM pairs GROUP BY ALL),
net AS (SELECT query_id, corpus, chunk, sum(f) / 3 AS net_flow FROM flows GROUP BY ALL)"""


_SCORED = f"""WITH {_POSTINGS},
cases AS (
  SELECT p.kind, p.corpus, p.record_ix, p.term, p.frequency, (sum(p.frequency) OVER (PARTITION BY p.kind, p.corpus, p.record_ix))::BIGINT AS length, t.occurrences, t.records
  FROM postings p JOIN terms t USING (term)),
whole AS (SELECT sum(frequency)::DOUBLE AS total, count(*)::DOUBLE AS n FROM postings),
logs AS (
  SELECT frequency, length, occurrences, count(*) AS same, any_value(n) AS n,
    list_transform(range(frequency, least(length, occurrences) + 1), lambda i:
      lgamma(occurrences + 1) - lgamma(i + 1) - lgamma(occurrences - i + 1)
      + lgamma(any_value(total) - occurrences + 1) - lgamma(length - i + 1) - lgamma(any_value(total) - occurrences - length + i + 1)
      - lgamma(any_value(total) + 1) + lgamma(length + 1) + lgamma(any_value(total) - length + 1)) AS terms
  FROM cases, whole GROUP BY frequency, length, occurrences),
tails AS (SELECT *, least(0, list_max(terms) + ln(list_sum(list_transform(terms, lambda x: exp(x - list_max(terms)))))) AS log_p FROM logs),
raised AS (SELECT *, least(0, log_p + ln(n) - ln(sum(same) OVER (ORDER BY log_p, frequency, length, occurrences))) AS q FROM tails),
adjusted AS (SELECT frequency, length, occurrences, log_p, min(q) OVER (ORDER BY log_p DESC, frequency DESC, length DESC, occurrences DESC) AS log_q FROM raised)
SELECT kind, corpus, record_ix, term, frequency, length, occurrences, records, round(log_p, 4) + 0.0 AS log_p, round(log_q, 4) + 0.0 AS log_q,
  round(-log_q, 4) + 0.0 AS score, log_q <= ln(0.05::DOUBLE) AS distinctive
FROM cases JOIN adjusted USING (frequency, length, occurrences)"""

_PHRASES = r"""WITH records AS (SELECT row_number() OVER () AS r, coalesce(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), []) AS w FROM search_chunk),
grams AS (
  SELECT r, k AS length, array_to_string(w[i:i + k - 1], ' ') AS ngram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM records, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
counts AS (SELECT ngram, length::INT AS length, count(*) AS occurrences, count(DISTINCT r) AS records FROM grams GROUP BY ALL)
SELECT ngram, length, occurrences, records, records::DOUBLE / n AS record_share, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * n THEN 'common' ELSE 'useful' END AS mark
FROM counts, (SELECT count(*) AS n FROM search_chunk)"""


def _cuts(kind: str, table: str, limit: int) -> str:
    # Of the texts over the limit, the longest run of words between two neighbouring boundaries.
    white = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    ends = r"""([.!?]["'”’»›)\]}]*)""" + white
    return f"""SELECT '{kind}' AS item_kind, id AS item_id,
  CASE WHEN list_max(list_transform(string_split(regexp_replace(content, '{ends.replace("'", "''")}', E'\\\\1\\n', 'g'), E'\\n'),
    lambda s: len(list_filter(regexp_split_to_array(s, '{white}+'), lambda w: w <> '')))) > {limit} THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT id, arg_max(content, ingested_at) AS content FROM {table} WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)
WHERE len(list_filter(regexp_split_to_array(content, '{white}+'), lambda w: w <> '')) > {limit}"""


SQL: dict[str, str] = {
    "p1_frequencies": _MARKED,
    "p1_found": f"SELECT term, mark FROM ({_MARKED}) WHERE mark <> 'useful'",
    "p1_phrases": _PHRASES,
    "p2_scores": _SCORED,
    "p2_found": f"""WITH {_POSTINGS}
SELECT p.corpus, p.record_ix, p.term FROM (SELECT *, sum(frequency) OVER (PARTITION BY kind, corpus, record_ix) AS length FROM postings) p
JOIN terms t ON t.term = p.term, size WHERE p.frequency * 5 >= p.length AND t.records <= 0.03 * n""",
    "p3_found": f"{_ORDERED} SELECT query_id, corpus, chunk FROM net QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(net_flow, 9) DESC, corpus, chunk) = 1",
    "p3_order": f"{_ORDERED} SELECT query_id, corpus, chunk, round(net_flow, 9) + 0.0 AS net_flow FROM net",
    "p6_found": _cuts("document", "search_document", 600) + " UNION ALL " + _cuts("chunk", "search_chunk", 180),
    "p7_found": f"""WITH {_VECTORS}
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id AND a.dimensions = b.dimensions
WHERE list_cosine_similarity(a.v, b.v) >= 0.95""",
}
