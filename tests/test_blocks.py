"""Batches of queries are scored block by block: what is shuffled and written does not grow with queries times chunks."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import search
from lexloom.operators.index import build_index, read_index, unfielded_blocks, unfielded_postings, with_vectors, write_index, write_index_v1
from lexloom.operators.search import Options
from lexloom.runtime import materialize

CHUNKS, QUERIES = 600, 80
CHUNK = "corpus string, chunk_ix int, id string, document_id string, url string, title string, heading string, content string, lang string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("c", k, f"i{k:03}", f"d{k // 2}", "/u", "Alpha", None, f"alpha beta {'gamma ' * (k % 5)}", "en" if k % 3 else None) for k in range(CHUNKS)]
    return materialize(spark.createDataFrame(rows, CHUNK), "rows")


@pytest.fixture(scope="module")
def index(spark, chunks):
    v = chunks.select("corpus", "chunk_ix", F.array(F.lit(1.0), F.col("chunk_ix") % 7).cast("array<float>").alias("embedding"))
    return with_vectors(build_index(chunks, keep=("lang",)), materialize(v, "vectors"))


@pytest.fixture(scope="module")
def queries(spark):
    return materialize(spark.createDataFrame([(k, "alpha beta ", [1.0, float(k % 3)]) for k in range(QUERIES)], "query_id long, text string, query_vector array<float>"), "asked")


def moved(spark, make):
    """Rows that the stages of ``make`` shuffle or write, and what it gives."""

    def stages():
        jvm = spark.sparkContext._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s := every.apply(k)).stageId(): s.shuffleWriteRecords() + s.outputRecords() for k in range(every.size())}

    before = stages()
    got = make()
    return sum(n for k, n in stages().items() if k not in before), got


def page(**options):
    return lambda index, chunks, queries, root: search.search(index, queries, Options(**options), details=False).collect()


def round_trip(index, chunks, queries, root):
    write_index(index, f"{root}/ix")
    return search.search(read_index(chunks.sparkSession, f"{root}/ix"), queries, Options(max_expansions=0)).collect()


def round_trip_v1(index, chunks, queries, root):
    made = unfielded_blocks(chunks)
    write_index_v1(*unfielded_postings(chunks, made), chunks, f"{root}/v1", packed=made)
    return search.unfielded(*unfielded_postings(chunks, made), queries, chunks.sparkSession.read.parquet(f"{root}/v1/blocks")).collect()


# What a finding named: how many rows it gives, and how it is made.
CASES = {
    "F1": (QUERIES * 2, lambda index, chunks, queries, root: search.search_facets(index, queries, Options(max_expansions=0, facets=("lang",))).collect()),
    "F2": (QUERIES * 10, round_trip),
    "F3": (QUERIES * 3, lambda index, chunks, queries, root: search.search(index, queries, Options(limit=3), hydrate=True).collect()),
    "F4": (QUERIES * CHUNKS, lambda index, chunks, queries, root: search.lexical_scores(index, queries, Options(max_expansions=0)).collect()),
    "F5": (QUERIES * 10, page(max_expansions=0)),
    "F6": (QUERIES * CHUNKS, round_trip_v1),
    "F7": (QUERIES * 10, page(max_expansions=0, where={"lang": "en"})),
    "F8": (QUERIES * CHUNKS, lambda index, chunks, queries, root: search.both_scores(chunks, index.analyzer, queries).collect()),
    "F9": (QUERIES * CHUNKS, lambda index, chunks, queries, root: search.lexical_scores(index, queries).collect()),
    "F10": (QUERIES * 10, page(max_expansions=0, group_by="expanded")),
    "F11": (QUERIES * 10, page(mode="hybrid", semantic_weight=0.4)),
    "F12": (QUERIES * 4, page(max_expansions=0, group_by="none", offset=3, limit=4)),
    "F13": (QUERIES * 10, page(max_expansions=0, weights={"title": 5.0, "heading": 1.0, "body": 0.5})),
    "F14": (QUERIES * 10, page(mode="semantic")),
}


@pytest.mark.parametrize("finding", list(CASES))
def test_matches_are_not_shuffled(spark, index, chunks, queries, tmp_path, finding):
    rows, make = CASES[finding]
    n, got = moved(spark, lambda: make(index, chunks, queries, str(tmp_path)))
    assert len(got) == rows
    # Each of the 80 queries matches all 600 chunks: 48,000 pairs.
    assert n < QUERIES * CHUNKS / 3, n
