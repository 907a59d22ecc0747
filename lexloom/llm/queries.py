"""The pN_ queries: every problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import enrichment, markup, mixing, multiindex, outranking, packing, pagediff, postings, reading, splitter, term_counts
from lexloom.llm.tokens import token_count
from lexloom.runtime import materialize, scoped, table

CAPACITY = 2048


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return materialize(postings.current_postings(table(spark, d, "lexical_posting_v1"), table(spark, d, "lexical_posting_v2")), "postings")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(_postings(spark, d))


def p1_phrases(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.phrase_frequencies(table(spark, d, "search_chunk").select(F.col("content").alias("text")), 3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequencies(spark, d).where("mark IN ('rare', 'common')").select("term", "mark")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    logs = ["log_p", "log_q", "score"]
    return enrichment.enrich(_postings(spark, d)).withColumns({c: F.round(c, 4) + F.lit(0.0) for c in logs})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    own = _postings(spark, d)
    records = own.select(*postings.RECORD).distinct().count()
    scored = enrichment.enrich(own).where("score > 0")
    return scored.where((F.col("frequency") * 5 >= F.col("length")) & (F.col("records") * 100 <= F.lit(3 * records))).select("corpus", "record_ix", "term")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return materialize(outranking.candidates(table(spark, d, "lexical_score_v2"), table(spark, d, "search_query"), table(spark, d, "decoded_vector_v2")), "candidates")


def p3_order(spark: SparkSession, d: str) -> DataFrame:
    return outranking.rank_candidates(_candidates(spark, d)).withColumn("net_flow", F.round("net_flow", 9) + F.lit(0.0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return outranking.first_of_each(p3_order(spark, d))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "search_document"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_clean(spark, d).where(F.size("kinds") > 0).select("id", "field")


def p5_body(spark: SparkSession, d: str) -> DataFrame:
    return pagediff.differenced(table(spark, d, "search_document"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_body(spark, d).select("id", F.explode("boilerplate").alias("line_ix")).select("id", F.col("line_ix").cast("long").alias("line_ix"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.pieces(materialize(splitter.oversized(table(spark, d, "search_document"), table(spark, d, "search_chunk")), "items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitter.item_cuts(p6_pieces(spark, d))


def p7_knn(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.knn(table(spark, d, "decoded_vector_v2"), F.col("vec_id") % 20 == 0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.similar_pairs(table(spark, d, "decoded_vector_v2"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), token_count("text").alias("tokens"))
    return packing.pack(materialize(sizes, "sizes"), CAPACITY)


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(_packed(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("piece_ix = 1").select(F.col("item_id").alias("doc_id")).distinct()


def _sized(spark: SparkSession, d: str) -> DataFrame:
    # Blank texts are no copies of each other; equal texts are told by 128 bits of their hash.
    key = F.when(F.trim("text") != "", F.md5(F.col("text").cast("binary")))
    docs = table(spark, d, "documents").select("doc_id", mixing.source_key("source").alias("source"), key.alias("text_key"), token_count("text").alias("tokens"))
    return materialize(mixing.members(materialize(docs, "sized")), "members")


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_sized(spark, d), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), table(spark, d, "mix_target")
    return mixing.shares(mixing.draw(sized, targets), sized, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = mixing.mix_plan(_sized(spark, d), table(spark, d, "mix_target"))
    return spark.createDataFrame([(r[0],) for r in rows if r[5] < r[3]], "source string")


def p10_grades(spark: SparkSession, d: str) -> DataFrame:
    return reading.graded(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.banded(p10_grades(spark, d))


_MADE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_frequencies": p1_frequencies,
    "p1_phrases": p1_phrases,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p3_found": p3_found,
    "p3_order": p3_order,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p5_body": p5_body,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_knn": p7_knn,
    "p8_found": p8_found,
    "p8_pack": p8_pack,
    "p8_usage": p8_usage,
    "p9_found": p9_found,
    "p9_draw": p9_draw,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_grades": p10_grades,
}

QUERIES = {name: scoped(make) for name, make in _MADE.items()}
