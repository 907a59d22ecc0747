import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import highlight, scoring, stem, text
from lexloom.operators import filters, synthetic


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_folding_and_stems(spark):
    assert column(spark, ["Crème", "BRÛLÉE", "ﬁne", "plain", None], text.fold) == ["creme", "brulee", "fine", "plain", None]
    words = ["configuring", "connections", "classes", "ponies", "agreed", "agreedly", "hopping", "falling", "conflated", "relational", "hopefulness", "sky", "cry", "happy", "cats", "gas", "this", "adjustment", "cease", "rate", "a", "ing", "sing", "national", "formalize", None]
    got = column(spark, words, stem.stem_english)
    assert got[:2] == ["configur", "connect"]
    # An ending that leaves too little is no reason to look for a shorter one; a short eed word falls on to ed.
    fixed = {"element": "element", "elements": "element", "need": "ne", "feed": "fe", "deed": "de", "agreed": "agre", "cement": "cement", "movement": "mov"}
    assert column(spark, list(fixed), stem.stem_english) == list(fixed.values()) == [stem.stem_word(w) for w in fixed]
    assert got[:-1] == [stem.stem_word(w) for w in words[:-1]] and got[-1] is None


def test_levenshtein_is_the_edit_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(7)
    pairs = [("".join(rng.choices("abcdef", k=rng.randint(1, 10))), "".join(rng.choices("abcdef", k=rng.randint(1, 10)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", *[F.levenshtein("a", "b", k).alias(f"d{k}") for k in (1, 2)]).collect():
        d = distance(r.a, r.b)
        assert (r.d1, r.d2) == (d if d <= 1 else -1, d if d <= 2 else -1)


def test_routes_names_sizes():
    import re

    fits = lambda g, u: bool(re.match(text.glob_regex(g), u))
    assert fits("/**", "/a/b") and fits("/docs/**", "/docs") and fits("/docs/*", "/docs/a") and not fits("/docs/*", "/docs/a/b") and fits("/{a,b}/x", "/b/x")
    assert text.parse_bytes("1.5 kB") == 1500 and text.parse_bytes("2GiB") == 2**31 and text.format_bytes(2_500_000) == "2.5 MB"
    for bad in ("1TB", "x", ""):
        with pytest.raises(ValueError):
            text.parse_bytes(bad)
    assert text.provider_directory("a/b é") == "a~2fb~20~c3~a9" and text.provider_directory("..") == "~2e~2e"
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            text.safe_name(bad)
    with pytest.raises(ValueError):
        text.safe_key("/etc/x")


def test_bm25f_value(spark):
    df = spark.createDataFrame([(2, 1, 3, 2, 1, 3, 2.0, 1.0, 3.0, 1, 1)], "tf_title int, tf_heading int, tf_body int, len_title int, len_heading int, len_body int, avg_title double, avg_heading double, avg_body double, df long, n long")
    got = df.select(scoring.bm25f(F.col("df"), F.col("n"), scoring.WEIGHTS, F.lit(1.0))).first()[0]
    assert abs(got - math.log(1 + 0.5 / 1.5) * 8.5 * 2.2 / (8.5 + 1.2)) < 1e-12


def test_int8(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([-1.0, 0.0],), ([0.0, 0.0],)], "v array<float>")
    scale = scoring.quantize_scale(F.col("v"))
    rows = df.select(scoring.quantize(F.col("v"), scale).alias("q"), scale.alias("s"), scoring.cosine(F.col("v"), scoring.quantize(F.col("v"), scale)).alias("c")).collect()
    assert rows[0].q == [95, 127] and rows[1].q == [-127, 0] and rows[2].q == [0, 0] and rows[2].c == 0
    assert rows[0].c > 0.999


def test_highlight_and_excerpt(spark):
    terms = [{"term": "cafe", "source": "cafe", "kind": "exact"}, {"term": "authentication", "source": "authentcation", "kind": "fuzzy"}]
    line = "Try café authentication today"
    assert highlight.ranges(line, terms) == [(4, 8), (9, 23)]
    assert highlight.ranges(line, [{"term": "authentication", "source": "auth", "kind": "prefix"}]) == [(9, 23)]
    long = "word " * 60 + line + " word" * 60
    got, hits = highlight.excerpt(long, terms, 40)
    assert got.startswith("…") and got.endswith("…") and [got[a:b] for a, b in hits] == ["café", "authentication"]
    assert highlight.excerpt("", [], 5) == ("", [])


def test_filters(spark):
    df = spark.createDataFrame([(1, "en", ["a", "b"], 5.0), (2, None, None, None), (3, "de", ["c"], 2.0), (4, "en", [None], 3.0)], "k int, lang string, tags array<string>, stars double")
    ids = lambda where: [r.k for r in df.where(filters.matches(df, where)).orderBy("k").collect()]
    assert ids({}) == ids(None) == [1, 2, 3, 4]
    assert ids({"lang": "en"}) == [1, 4] and ids({"lang": None}) == [2] and ids({"lang": []}) == []
    assert ids({"tags": "b"}) == [1] and ids({"tags": ["b", "c"]}) == [1, 3] and ids({"tags": [None]}) == [2, 4]
    assert ids({"stars": {"gte": 3}}) == [1, 4] and ids({"lang": {"gte": 3}}) == [] and ids({"stars": "5"}) == []
    assert ids({"tags": {"exists": False}}) == [2] and ids({"gone": None}) == [1, 2, 3, 4] and ids({"gone": 1}) == []
    assert ids({"lang": "en", "stars": {"lt": 4, "in": [3]}}) == [4]
    assert filters.toggle_facet({}, "lang", "en") == {"lang": {"in": ["en"]}}
    assert filters.toggle_facet({"lang": {"in": ["en"]}}, "lang", "en") == {}
    assert filters.toggle_facet({"stars": {"gte": 2, "in": [3]}}, "stars", "3") == {"stars": {"gte": 2}}


def test_synthetic_queries(spark):
    rows = [("x", 0, "b", "doc-b", "Authentication", "Configure OAuth", "Set the callback credential and redirect address."), ("x", 1, "a", "doc-a", "Canvas guide", "Draw shapes", "Render a rectangle with the drawing context.")]
    df = spark.createDataFrame(rows, "corpus string, chunk_ix int, id string, document_id string, title string, heading string, content string")
    got = synthetic.synthetic_queries(df, seed=7)
    assert [g["query"] for g in got] == ["Configure OAuth", "Authentication address", "dadress", "Draw shapes", "Canvas guide context", "contetx"]
    assert got == synthetic.synthetic_queries(df, seed=7) and all(g["synthetic"] for g in got)
