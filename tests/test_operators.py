import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import Analyzer, register_stemmer
from lexloom.operators import chunking, evaluate, search, vectors
from lexloom.operators.index import build_index, index_faults, number_chunks, read_index, with_vectors, write_index
from lexloom.operators.scan import following_min, range_layout, running_sum
from lexloom.operators.search import Options
from lexloom.operators.skew import skew_join
from lexloom.sources import documents, html, store

CHUNK = "corpus string, chunk_ix int, id string, document_id string, url string, title string, heading string, content string, tags array<string>, stars int"


def test_scans(spark):
    rows = [("a" if k % 3 else None, k % 7, k) for k in range(200)] + [("hot", 1, k) for k in range(1000, 1500)]
    df = spark.createDataFrame(rows, "g string, o int, k int")
    laid = range_layout(df, ["g"], ["o", "k"], 5)
    got = running_sum(laid, ["g"], ["o", "k"], F.col("k"), "s")
    least = following_min(laid, ["g"], ["o", "k"], F.col("k"), "m")
    sums: dict = {}
    want = {}
    for g, _o, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        sums[g] = sums.get(g, 0) + k
        want[g, k] = sums[g]
    assert {(r.g, r.k): r.s for r in got.collect()} == want
    after = {(g, k): min(y for h, p, y in rows if h == g and (p, y) >= (o, k)) for g, o, k in rows}
    assert {(r.g, r.k): r.m for r in least.collect()} == after
    assert running_sum(range_layout(df.limit(0), ["g"], ["o", "k"]), ["g"], ["o", "k"], F.col("k"), "s").count() == 0


def test_skew_join(spark):
    big = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k % 40}", k) for k in range(100)] + [(None, 1), ("lost", 2)], "key string, n int")
    one = spark.createDataFrame([("hot", 1), *[(f"k{k}", k) for k in range(40)]], "key string, v int")
    assert skew_join(big, one, ["key"]).count() == 400
    left = skew_join(big, one, ["key"], "left")
    assert left.count() == 402 and left.where("v IS NULL").count() == 2


def test_sections_and_windows(spark):
    docs = spark.createDataFrame([("d", "/u", "", "intro\n# Install\nrun it\n\n## Empty\n# Configure\n" + "w " * 400), ("n", "/n", None, None), ("e", "/e", "T", "  ")], "id string, url string, title string, content string")
    s = chunking.text_sections(docs)
    assert [(r.title, r.heading, r.section[:6]) for r in s.orderBy("section_ix").collect()] == [("/u", None, "intro"), ("/u", "Install", "run it"), ("/u", "Configure", "w w w ")]
    named = spark.createDataFrame([("h", "/h", None, "# Empty\n## First  one\r\ntext\rmore\n#\u00a0Second\nlast")], docs.schema)
    assert [(r.title, r.heading, r.section) for r in chunking.text_sections(named).orderBy("section_ix").collect()] == [("First one", "First one", "text more"), ("First one", "Second", "last")]
    c = chunking.chunks(s, 180, 30)
    assert [len(r.content.split()) for r in c.where("heading = 'Configure'").orderBy("window_ix").collect()] == [180, 180, 100]
    for n in (1, 20, 179, 180, 181, 330, 331, 699):
        for most, overlap in ((180, 30), (20, 19), (50, 0), (5, 99)):
            got = chunking.windows(spark.createDataFrame([(" ".join(map(str, range(n))),)], "section string"), most, overlap).count()
            m = max(20, most)
            o = min(overlap, m - 1)
            at, want = 0, 1
            while at + m < n:
                at, want = at + m - o, want + 1
            assert got == want


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("docs", 0, "s1", "search", "/s", "Search guide", "Tolerance", "Typo tolerance explained for search", ["search"], 5),
        ("docs", 1, "s2", "search", "/s", "Search guide", "More", "Another tolerance note", ["search"], 5),
        ("docs", 2, "a1", "auth", "/a", "Security", "Authentication", "Authentication tokens and authorize calls", ["security"], 3),
        ("more", 0, "m1", "other", "/m", None, None, None, None, None),
        ("more", 1, "m2", "other", "/m", "Canvas", "Draw", "Canvas canvas canvas", ["draw"], 1),
    ]
    return build_index(spark.createDataFrame(rows, CHUNK), keep=("tags", "stars"))


def run(spark, index, text, **options):
    got = search.search(index, spark.createDataFrame([(1, text)], "query_id long, text string"), Options(**options), hydrate=True)
    return got.orderBy("rank").collect()


def test_search(spark, index, tmp_path):
    auth = run(spark, index, "auth")
    assert [r.document_id for r in auth] == ["auth"] and {t.kind for t in auth[0].terms} == {"prefix"}
    typo = run(spark, index, "tolarance ", where={"tags": ["search"], "stars": {"gte": 4}}, group_by="expanded")
    assert len(typo) == 1 and typo[0].matches == 2 and typo[0].total == 1 and typo[0].terms[0].kind == "fuzzy" and len(typo[0].chunks) == 2
    page = run(spark, index, "tolerance ", group_by="none", offset=1, limit=1)
    assert len(page) == 1 and page[0].total == 2 and page[0].content
    assert run(spark, index, "tolerance ", limit=0) == [] and run(spark, index, "") == [] and run(spark, index, None) == []
    assert run(spark, index, "tolarance ", max_expansions=0) == []
    one, two = run(spark, index, "canvas ", corpora=("more",)), run(spark, index, "canvas canvas ", corpora=("more",))
    assert one[0].score == two[0].score == 1.0
    facets = search.search_facets(index, spark.createDataFrame([(1, "auth")], "query_id long, text string"), Options(facets=("tags",)))
    assert [(r.field, r.value, r.number) for r in facets.collect()] == [("tags", "security", 1)]
    assert {r.fault: r.number for r in index_faults(index).collect()}.values() and not any(r.number for r in index_faults(index).collect())
    write_index(index, str(tmp_path / "ix"))
    again = read_index(spark, str(tmp_path / "ix"))
    assert [r.id for r in run(spark, again, "tolerance ")] == [r.id for r in run(spark, index, "tolerance ")]
    assert search.query(index, "canvas ").first().id == "m2"


def test_title_beats_body_and_empty_index(spark):
    rows = [("c", 0, "b", "b", "/b", "Other", None, "canvas here", None, None), ("c", 1, "t", "t", "/t", "Canvas", None, "other here", None, None)]
    ix = build_index(spark.createDataFrame(rows, CHUNK))
    assert [r.id for r in run(spark, ix, "canvas ")] == ["t", "b"]
    assert run(spark, build_index(spark.createDataFrame([], CHUNK)), "canvas") == []


def test_analyzers(spark):
    rows = [("c", 0, "b", "b", "/b", "Connections", None, "configuring", None, None)]
    ix = build_index(spark.createDataFrame(rows, CHUNK), Analyzer(stemmer="en"))
    assert {r.term for r in ix.dictionary.collect()} == {"connect", "configur"} and [r.id for r in run(spark, ix, "connected ")] == ["b"]
    register_stemmer("first3", lambda w: F.substring(w, 1, 3))
    assert {r.term for r in build_index(spark.createDataFrame(rows, CHUNK), Analyzer(stemmer="first3")).dictionary.collect()} == {"con"}
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame(rows, CHUNK), Analyzer(stemmer="none such"))


def test_semantic_and_hybrid(spark, index):
    v = spark.createDataFrame([("docs", 0, [1.0, 0.0]), ("docs", 1, [0.0, 1.0]), ("docs", 2, [0.0, 0.0]), ("more", 1, None)], "corpus string, chunk_ix int, embedding array<float>")
    ix = with_vectors(index, v)
    q = spark.createDataFrame([(1, "tolerance ", [1.0, 0.0])], "query_id long, text string, query_vector array<float>")
    got = search.search(ix, q, Options(mode="semantic", group_by="none")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("s1", 1.0), ("a1", 0.5), ("s2", 0.5)]
    both = search.search(ix, q, Options(mode="hybrid", group_by="none", semantic_weight=0.25)).orderBy("rank").collect()
    assert both[0].id == "s1" and abs(both[0].score - (both[0].lexical_score * 0.75 + 0.25)) < 1e-12
    assert search.search(index, q, Options(mode="semantic")).count() == 0


def test_cache(spark):
    p = vectors.Provider("p", 1, lambda ts: [[len(t) / 100] for t in ts])
    texts = spark.createDataFrame([("1", "beta"), ("2", "alpha"), ("3", "beta"), ("4", None)], "id string, text string")
    empty = spark.createDataFrame([], vectors.CACHE)
    got, new = vectors.cached_embeddings(texts, p, empty)
    assert new.count() == 3 and {r.id: round(r.embedding[0], 2) for r in got.collect()} == {"1": 0.04, "2": 0.05, "3": 0.04, "4": 0.0}
    kept = spark.createDataFrame(new.collect(), vectors.CACHE)
    again, none = vectors.cached_embeddings(texts.where("id < '3'"), p, kept)
    assert none.count() == 0 and all(r.hit for r in again.collect())
    assert vectors.cached_embeddings(texts, vectors.Provider("p", 2, p.embed), kept)[1].columns == new.columns
    assert vectors.evict(kept, 8).count() == 2 and vectors.evict(kept, 0).count() == 0 and vectors.clear(kept).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.embed_texts(texts.select(F.col("id").alias("key"), "text"), vectors.Provider("bad", 3, p.embed)).collect()


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("q", "x", 0), ("m", "a", 1)], "query_id string, doc_id string, rel int")
    found = spark.createDataFrame([("q", k, d) for k, d in enumerate(["b", "u", "a", "c"], 1)] + [("z", 1, "a")], "query_id string, rank int, doc_id string")
    rows = {r.query_id: r for r in evaluate.graded_metrics(found, qrels, 4).collect()}
    lg = math.log2
    assert abs(rows["q"].ndcg - (2 + 3 / lg(4) + 1 / lg(5)) / (3 + 2 / lg(3) + 1 / lg(4))) < 1e-12 and rows["m"].ndcg == 0 and "z" not in rows
    three = {r.query_id: r for r in evaluate.graded_metrics(found, qrels, 3).collect()}["q"]
    assert abs(three.ap - (1 + 2 / 3) / 3) < 1e-12 and three.recall == three.precision == 2 / 3
    b = evaluate.binary_metrics(spark.createDataFrame([("q", k, d) for k, d in enumerate(["i", "a", "b", "c"], 1)], "query_id string, rank int, doc_id string"), spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string"), 3).first()
    assert b.recall == 1 and b.rr == 0.5 and abs(b.ndcg - (1 / lg(3) + 1 / lg(4)) / (1 + 1 / lg(3))) < 1e-12
    with pytest.raises(ValueError):
        evaluate.require_unique(found.union(found))
    assert evaluate.mean_metrics(evaluate.graded_metrics(found, qrels.limit(0))).first().ndcg == 0
    assert "| a | b |" in evaluate.markdown_table([{"a": 1, "b": 0.5}], ["a", "b"]) and "0.5000" in evaluate.text_table([{"b": 0.5}], ["b"])


def test_sources(spark, tmp_path):
    (tmp_path / "site" / "guide").mkdir(parents=True)
    page = "<html lang='en'><head><meta charset='windows-1252'><title>T</title><meta property='og:title' content='Graph'><meta name='version' content='2'></head><body><nav>Menu</nav><main><h1>Install</h1><p>Caf\xe9</p><aside>x</aside><h2>Configure</h2><ul><li><p>one</p></li></ul></main></body></html>"
    (tmp_path / "site" / "guide" / "index.html").write_bytes(page.encode("cp1252"))
    rows = documents.generated_html(spark, str(tmp_path / "site")).orderBy("section_ix").collect()
    assert [(r.id, r.title, r.heading, r.section) for r in rows] == [("/guide", "Graph", "Install", "Café"), ("/guide", "Graph", "Configure", "one")]
    assert rows[0].metadata["lang"] == "en" and rows[0].metadata["version"] == "2"
    (tmp_path / "md" / "a b").mkdir(parents=True)
    (tmp_path / "md" / "a b" / "index.md").write_text("---\ntitle: Hello\nlang: en\n---\n# Head\ntext")
    d = documents.filesystem(spark, str(tmp_path / "md")).first()
    assert (d.id, d.url, d.title, d.metadata["lang"]) == ("a b/index.md", "/a b", "Hello", "en") and d.content.startswith("# Head")
    assert html.sections(html.parse("plain words")) == [(None, "plain words")]
    j = tmp_path / "j.jsonl"
    j.write_text('{"query": "a", "relevant": ["x"]}\n\n{"query": "b", "relevant": [], "synthetic": true}\n')
    assert documents.read_judgments(spark, str(j)).count() == 2
    j.write_text('{"relevant": ["x"]}\n')
    with pytest.raises(ValueError):
        documents.read_judgments(spark, str(j))
    root = tmp_path / "beir"
    (root / "qrels").mkdir(parents=True)
    (root / "corpus.jsonl").write_text('{"_id": 1, "title": "t", "text": "x"}\n{"_id": "2", "text": "y"}\n')
    (root / "queries.jsonl").write_text('{"_id": 7, "text": "q"}\n{"_id": 8, "text": "unjudged"}\n')
    (root / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n7\t1\t1\n7\t99\t2\n")
    corpus, asked, qrels = documents.read_beir(spark, str(root))
    assert corpus.count() == 2 and [r.query_id for r in asked.collect()] == ["7"] and qrels.count() == 2
    (root / "qrels" / "test.tsv").write_text("7\t1\n")
    with pytest.raises(ValueError):
        documents.read_qrels(spark, str(root / "qrels" / "test.tsv"))


def test_store(spark, tmp_path):
    root = str(tmp_path / "out")
    (tmp_path / "out" / "old").mkdir(parents=True)
    (tmp_path / "out" / "docs").mkdir()
    assert store.remove_stale(spark, root, ["docs"]) == ["old"] and (tmp_path / "out" / "docs").exists()
    store.write_manifest(spark, root, {"docs": {"chunks": 1}}, "t")
    assert store.read_manifest(spark, root)["corpora"] == {"docs": {"chunks": 1}}
    df = number_chunks(spark.createDataFrame([("c", f"{k:03}", 400) for k in range(50)], "corpus string, id string, size int"), ["id"])
    packed = store.pack_shards(df, ["corpus", "id"], "size", 1000).groupBy("shard").sum("size").collect()
    assert all(r[1] <= 1000 for r in packed) and sum(r[1] for r in packed) == 20_000 and {r.shard for r in packed} == set(range(25))


def test_incremental_keeps_equal_headings(spark, tmp_path):
    from datetime import datetime as t

    from lexloom.streaming import incremental

    text = "# 1.1\n\n## Fixed\nalpha beta\n\n## Added\ngamma\n\n# 1.0\n\n## Fixed\ndelta beta\n\n## Added\n" + "epsilon " * 400
    docs = spark.createDataFrame([("a", "/a", "A", text, "c", t(2025, 1, 1)), ("b", "/b", "B", "plain text", "c", t(2025, 1, 1))], incremental.DOCUMENTS)
    provider = vectors.hashing_provider(8)
    incremental.apply_batch(docs, 0, str(tmp_path), provider)
    cut = chunking.chunks(chunking.text_sections(docs.drop("updated_at")))
    index = build_index(number_chunks(cut, ["document_id", "section_ix", "window_ix"]))
    tf = ["term", "tf_title", "tf_heading", "tf_body"]
    want = index.postings.join(index.chunks.select("corpus", "chunk_ix", "document_id"), ["corpus", "chunk_ix"])
    got = incremental.current(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("document_id", *tf).collect())) == sorted(map(tuple, want.select("document_id", *tf).collect()))
    assert got.select("chunk_ix").distinct().count() == cut.count() > 5
    assert spark.read.parquet(f"{tmp_path}/cache").count() == cut.select("content").distinct().count()


def test_sample_is_the_shuffle():
    import numpy as np

    from lexloom.operators import synthetic

    def plain(total, size, seed):
        draws, order = synthetic.Draws(seed), list(range(total))
        for last in range(total - 1, 0, -1):
            at = int(draws() * (last + 1))
            order[last], order[at] = order[at], order[last]
        return order[:size]

    for total, size, seed, block in ((1, 5, 1, 10), (2, 2, 3, 1), (50, 10, 7, 8), (400, 100, 0x5EE117, 64), (400, 400, 9, 1000), (0, 3, 1, 5)):
        assert synthetic.sample(total, size, seed, block) == plain(total, size, seed)
    draws = synthetic.Draws(42)
    assert np.allclose([draws() for _ in range(5)], synthetic.Draws(42).at(np.arange(1, 6)))
    assert synthetic.typo("aab", synthetic.Draws(1)) == "aba" and synthetic.typo("aaa", synthetic.Draws(1)) is None


def test_shards_do_not_hang_on_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(c, k, rng.choice([0, 1, 10, 300, 900, 2500]), "x") for c in ("a", "b", "c") for k in range({"a": 150, "b": 1, "c": 40}[c])]
    want, at = {}, (None, 0, 0)
    for c, k, n, _ in sorted(rows):
        shard, held = (0, n) if c != at[0] else (at[1] + 1, n) if at[2] and at[2] + n > 1000 else (at[1], at[2] + n)
        at = (c, shard, held)
        want[c, k] = shard
    df = spark.createDataFrame(rows, "corpus string, k int, size int, shard_of string")
    for parts in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.corpus, r.k): r.shard for r in store.pack_shards(df, ["corpus", "k"], "size", 1000).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert store.pack_shards(df.limit(0), ["corpus", "k"], "size", 1000).count() == 0


def test_config_build_and_runtime_vectors(spark, tmp_path):
    from lexloom.plans import config

    docs = [{"id": "canvas", "url": "/docs/canvas", "title": "Canvas", "content": "# Draw\ncanvas shapes", "metadata": {"tags": "ui", "version": "2.x", "author": "me"}}, {"id": "auth", "url": "/docs/auth", "title": "Authentication", "content": "tokens and calls", "metadata": None}, {"id": "old", "url": "/old/x", "title": "Old", "content": "canvas", "metadata": {}}]
    provider = vectors.hashing_provider(8)
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    corpora = {"docs": config.Corpus(docs, include=("/docs/**",), filters=("version",), facets=("tags",), vectors=config.Vectors(provider)), "late": config.Corpus(docs)}
    (tmp_path / "out" / "gone").mkdir(parents=True)
    first = config.build(spark, corpora, out, cache=cache)
    assert first["docs"] == {"documents": 2, "chunks": 2, "cached": 0, "embedded": 2} and first["late"]["documents"] == 3 and not (tmp_path / "out" / "gone").exists()
    assert config.build(spark, corpora, out, cache=cache)["docs"]["cached"] == 2 and not (tmp_path / "cache" / "lock").exists()
    found = config.Searcher(spark, out, {"late": provider})
    assert not found.loaded("docs")
    q = spark.createDataFrame([(1, "canvas ", [float(x) for x in provider.embed(["canvas"])[0]])], "query_id long, text string, query_vector array<float>")
    page = search.search(found.index(("docs",)), q, Options(where={"version": "2.x"}), hydrate=True).collect()
    assert [r.id for r in page] and page[0].document_id == "canvas" and page[0].metadata == {"author": "me"} and page[0].tags == "ui" and found.loaded("docs")
    assert found.index(("late",)).vectors is None and found.index(("late",), vectors=True).vectors.count() == 3
    assert search.search(found.index(vectors=True), q, Options(mode="hybrid")).count() == 5
    assert config.built_chunks(spark, out, "docs").count() == 2
    assert config.build(spark, {"docs": corpora["docs"]}, str(tmp_path / "v1"), version=1)["docs"]["chunks"] == 2
    assert {r.document_id for r in config.built_chunks(spark, str(tmp_path / "v1"), "docs").collect()} == {"canvas", "auth"}
    for bad in ({"a/b": corpora["late"]}, {"..": corpora["late"]}):
        with pytest.raises(ValueError):
            config.build(spark, bad, out)
    with pytest.raises(ValueError):
        config.build(spark, corpora, out, version=3)


def test_formats_rank_alike(spark, tmp_path):
    from lexloom.operators.index import read_index_v1, unfielded_postings, write_index_v1

    rows = [("c", k, n, n, f"/{n}", t, None, c, None, None) for k, (n, t, c) in enumerate([("canvas", "Canvas", "drawing on the canvas"), ("auth", "Authentication", "signing in"), ("deploy", "Deployment", "shipping a canvas")])]
    chunks = spark.createDataFrame(rows, CHUNK)
    write_index_v1(*unfielded_postings(chunks), chunks, str(tmp_path / "v1"))
    p, n, _, v = read_index_v1(spark, str(tmp_path / "v1"))
    q = spark.createDataFrame([(1, "canvas ")], "query_id long, text string")
    one = [r.chunk_ix for r in search.unfielded(p, n, q).orderBy(F.desc("score")).collect()]
    two = [r.chunk_ix for r in search.lexical(build_index(chunks), q).orderBy(F.desc("lexical_score")).collect()]
    assert one == two == [0, 2] and v is None
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "v1"))


def test_runner(spark, index):
    from lexloom.operators import runner

    q = spark.createDataFrame([(1, "tolerance "), (2, "nothing ")], "query_id long, text string")
    j = spark.createDataFrame([(1, "s2"), (2, "auth")], "query_id long, doc_id string")
    run, hits = runner.run_candidates(spark, {"plain": runner.Candidate(), "chunks": runner.Candidate(query={"group_by": "none"})}, lambda c: (index, ("lexical",)), q, j)
    by = {r["candidate"]: r for r in run["results"]}
    assert by["plain"]["recall"] == 0.0 and by["chunks"]["recall"] == 0.5 and by["chunks"]["rr"] == 0.25
    own = hits.where("candidate = 'chunks'")
    assert {(r.id, r.doc_id) for r in runner.relevance_keys(own, j).collect()} == {("s1", "search"), ("s2", "s2")}
    assert {r.query_id: r["first"] for r in runner.first_relevant(own, j).collect()} == {1: 2, 2: None}
    with pytest.raises(ValueError):
        runner.run_candidates(spark, {}, lambda c: (index, ("lexical",)), q, j.limit(0))
    page, more = runner.load_more(index, q, Options(group_by="none", limit=1), 0)
    assert [r.more for r in page.withColumn("more", more).collect()] == [True]
    page, more = runner.load_more(index, q, Options(group_by="none", limit=1), 1)
    assert [(r.rank, r.more) for r in page.withColumn("more", more).collect()] == [(2, False)]


def test_locks_reports_and_front_matter(spark, tmp_path):
    import json

    from lexloom.functions import text

    with store.locked(spark, str(tmp_path / "lock")):
        with pytest.raises(TimeoutError), store.locked(spark, str(tmp_path / "lock"), wait=0.2):
            pass
    with store.locked(spark, str(tmp_path / "lock")), store.locked(spark, str(tmp_path / "lock"), stale=-1):
        pass
    made, shown = documents.ranking_report([{"dataset": "d", "engine": "a|b", "ndcg": 0.5, "query_ms": None}], [{"engine": "a", "datasets": 1, "ndcg": 0.5, "ms_per_query": 2.0}], [{"kind": "sanity", "dataset": "d", "engine": "a", "actual": None, "minimum": 0.4}])
    assert json.loads(made)["datasets"][0]["ndcg"] == 0.5 and "a\\|b" in shown and "budget exceeded" in shown and "minimum 0.400" in shown
    documents.write_run(spark, str(tmp_path / "run.json"), {"version": 1, "name": "r", "created_at": "t", "environment": {}, "results": []})
    assert documents.read_runs(spark, str(tmp_path / "run.json")).first().name == "r"
    sizes = {r.bucket: r for r in documents.artifact_sizes(spark, str(tmp_path), True).collect()}
    assert sizes[None].bytes > 0 and sizes[None].gzip_bytes > 0
    meta, rest = html.front_matter("---\ntitle: 'A: b' # c\ntags: [x, \"y\"]\nlist:\n  - one\n  - two\nnest:\n  deep: 3\n# no\n---\nbody")
    assert rest == "body" and meta == {"title": "A: b", "tags": "x,y", "list": "one,two", "nest.deep": "3"}
    (tmp_path / "g" / "a").mkdir(parents=True)
    for name in ("g/top.md", "g/a/in.md", "g/a/no.txt"):
        (tmp_path / name).write_text("x")
    assert {r.id for r in documents.filesystem(spark, str(tmp_path / "g"), "a/*.md").collect()} == {"a/in.md"} and documents.filesystem(spark, str(tmp_path / "g")).count() == 2
    df = spark.createDataFrame([("",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(text.xxh64(F.col("t"))).collect()] == ["ef46db3751d8e999", "d24ec4f1a98c6e5b", None]


def test_stream_index_and_removal(spark, tmp_path):
    from datetime import datetime as t

    from lexloom.streaming import incremental

    out = str(tmp_path)
    assert incremental.current(spark, out).count() == 0
    docs = spark.createDataFrame([("a", "/a", "Canvas", "draw here", "c", t(2025, 1, 1)), ("b", "/b", "Auth", "canvas too", "c", t(2025, 1, 1))], incremental.DOCUMENTS)
    incremental.apply_batch(docs, 0, out)
    index = incremental.current_index(spark, out)
    assert [r.document_id for r in run(spark, index, "canvas ")] == ["a", "b"]
    incremental.apply_batch(docs.where("id = 'a'").withColumn("removed", F.lit(True)), 1, out)
    assert [r.document_id for r in run(spark, incremental.current_index(spark, out), "canvas ")] == ["b"]
    same = spark.createDataFrame([("a", "/a", x, "y", "c", None) for x in ("one", "two")], incremental.DOCUMENTS)
    assert [r.title for r in incremental.latest(same).collect()] == ["two"]


def test_config_files_and_sites(spark, tmp_path):
    import hashlib
    import json

    from lexloom.plans import config

    (tmp_path / "site" / "a").mkdir(parents=True)
    (tmp_path / "site" / "a" / "index.html").write_text("<html><head><title>T</title></head><body><main><h1>Canvas</h1><p>draw on it</p></main></body></html>")
    assert config.build_site(spark, str(tmp_path / "site"), str(tmp_path / "out"))["site"] == {"documents": 1, "chunks": 1, "cached": 0, "embedded": 0}
    assert [r.document_id for r in run(spark, config.Searcher(spark, str(tmp_path / "out")).index(), "canvas ")] == ["/a"]
    provider = vectors.hashing_provider(4, "named")
    config.register_provider(provider)
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"corpora": {"docs": {"options": {"root": str(tmp_path / "site")}, "include": ["/**"], "filters": ["lang"], "stemmer": "en", "vectors": {"provider": provider.id, "mode": "runtime"}}}}))
    got = config.load_config(spark, str(path))["docs"]
    assert got.analyzer.stemmer == "en" and got.columns == ("lang",) and got.vectors.mode == "runtime" and got.modes == config.MODES
    for bad in ({}, {"corpora": {}}, {"corpora": {"a": {"fields": 1}}}, {"corpora": {"a": {"vectors": {"provider": "none"}}}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load_config(spark, str(path))
    raw = path.read_bytes()
    assert documents.checked(spark, str(path), hashlib.sha256(raw).hexdigest()) == str(path)
    with pytest.raises(ValueError):
        documents.checked(spark, str(path), "0" * 64)
