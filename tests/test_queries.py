import oracle
import pytest

from lexloom.plans.queries import QUERIES
from lexloom.plans.sql import SQL

TINY = oracle.SMALL.replace("sf0.01", "sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    oracle.compare(spark, name, QUERIES[name], SQL[name], TINY)


def rows_of(sql):
    return oracle.connect(TINY).sql(sql).fetchall()


def test_every_query_is_checked():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == {"html_sections", "hybrid_search", "semantic_search", "snippets", "synthetic_queries"}


def test_html_sections(spark):
    from lexloom.sources import html

    pages = rows_of("SELECT DISTINCT id, content FROM search_document WHERE url ILIKE 'http%' AND regexp_matches(content, '(?i)^\\s*<(!doctype\\s+html|html|head|body)[\\s>]')")
    want = []
    for i, text in pages:
        p = html.page(text, i)
        want += [(i, p["title"], k, h, s) for k, (h, s) in enumerate(zip(p["headings"], p["sections"], strict=True))]
    got = [tuple(r) for r in QUERIES["html_sections"](spark, TINY).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


@pytest.mark.parametrize("mode", ["hybrid_search", "semantic_search"])
def test_vector_searches_match_brute_force(spark, mode):
    import numpy as np

    from lexloom.functions.text import Analyzer
    from lexloom.operators import search
    from lexloom.operators.vectors import hashing_provider
    from lexloom.plans.queries import asked, built

    ix, embed = built(spark, TINY), hashing_provider().embed
    chunks = ix.chunks.join(ix.content, ["corpus", "chunk_ix"]).collect()
    v = embed(["\n".join([c.title or "", c.heading or "", c.content or ""]) for c in chunks]).astype(np.float64)
    norms = np.linalg.norm(v, axis=1)
    q = asked(spark, TINY).collect()
    lex = {(r.query_id, r.corpus, r.chunk_ix): r.lexical_score for r in search.lexical(ix, asked(spark, TINY)).collect()}
    top: dict = {}
    for (i, c, _), s in lex.items():
        top[i, c] = max(top.get((i, c), 0), s)
    want = []
    for r in q:
        a = embed([r.text or ""])[0].astype(np.float64)
        cos = np.divide(v @ a, norms * np.linalg.norm(a), out=np.zeros(len(v)), where=norms * np.linalg.norm(a) > 0)
        best: dict = {}
        for c, s in zip(chunks, (cos + 1) / 2, strict=True):
            own = lex.get((r.query_id, c.corpus, c.chunk_ix), 0.0) / top.get((r.query_id, c.corpus), 1.0)
            score = s if mode == "semantic_search" else 0.6 * own + 0.4 * s
            if score > 0:
                best.setdefault((c.corpus, c.document_id), []).append((-round(score, 9), c.chunk_ix, c.corpus, c.id, score))
        firsts = sorted((min(x) for x in best.values()), key=lambda x: (x[0], x[2], x[3]))[:10]
        want += [(r.query_id, k, x[2], x[3], round(x[4], 6)) for k, x in enumerate(firsts, 1)]
    got = [(r.query_id, r.rank, r.corpus, r.id, r.score) for r in QUERIES[mode](spark, TINY).collect()]
    assert Analyzer() == ix.analyzer and [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert all(abs(a[4] - b[4]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert sum(a == b for a, b in zip(sorted(got), sorted(want), strict=True)) > 0.98 * len(want)


def test_snippets(spark):
    got = QUERIES["snippets"](spark, TINY).collect()
    content = {r[0]: r[1] for r in rows_of("SELECT id, content FROM search_chunk QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1")}
    assert len(got) == 3 and all(r.hits > 0 for r in got)
    assert all(r.snippet.strip("…") in content[r.id] and r.rank <= 3 for r in got)


def test_synthetic_queries(spark):
    chunks = {(r[0], r[1]) for r in rows_of("SELECT document_id, coalesce(nullif(heading, ''), title) FROM search_chunk")}
    got = QUERIES["synthetic_queries"](spark, TINY).collect()
    assert 100 < len(got) <= 300 and len({r.query for r in got}) == len(got) and all(r.synthetic and len(r.relevant) == 1 for r in got)
    headed = {(d, " ".join(h.split())) for d, h in chunks if h}
    assert sum((r.relevant[0], r.query) in headed for r in got) > 50
