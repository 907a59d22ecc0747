"""Sections and sliding word windows: documents -> chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import WHITE, chunk_id, clean

MAX_WORDS, OVERLAP = 180, 30


def text_sections(documents: DataFrame) -> DataFrame:
    """One row a section of plain text: (all columns of ``documents``, section_ix, heading, section).

    ``documents(id, url, title, content, ...)``. A line of one to six ``#`` and a heading opens a section;
    its lines are joined and cleaned; sections without text are left out. A blank title becomes the heading
    of the first section with text, else (as where that one has no heading) the url. Null contents have no sections. Lines are handled inside the row, so neither a
    long document nor many sections need a shuffle.
    """
    lines = F.split(F.coalesce("content", F.lit("")), r"\r?\n", -1)
    mark = rf"^#{{1,6}}[{WHITE}]+([^\r\n\x{{2028}}\x{{2029}}]+)\z"
    start = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("lines"))
    state = F.struct(F.array().cast("array<struct<heading:string,lines:array<string>>>").alias("done"), start.alias("now"))

    def step(s: Column, line: Column) -> Column:
        opened = F.struct(clean(F.regexp_extract(line, mark, 1)).alias("heading"), F.array().cast("array<string>").alias("lines"))
        longer = F.struct(s["now"]["heading"].alias("heading"), F.concat(s["now"]["lines"], F.array(line)).alias("lines"))
        closed = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), opened.alias("now"))
        return F.when(line.rlike(mark), closed).otherwise(F.struct(s["done"].alias("done"), longer.alias("now")))

    every = F.aggregate(lines, state, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    each = F.transform(every, lambda x: F.struct(x["heading"].alias("heading"), clean(F.array_join(x["lines"], " ")).alias("section")))
    filled = F.filter(each, lambda x: x["section"] != "")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.get(filled, F.lit(0))["heading"], F.lit("")), F.col("url"))
    out = documents.withColumn("title", title).select("*", F.posexplode(filled).alias("section_ix", "_s"))
    return out.select("*", F.col("_s.heading").alias("heading"), F.col("_s.section").alias("section")).drop("_s")


def window_count(words: Column, most: int, overlap: int) -> Column:
    """Windows of ``most`` words that overlap by ``overlap`` until the end is reached."""
    return F.when(words > 0, 1 + F.ceil(F.greatest(F.lit(0), words - most) / (most - overlap))).otherwise(0).cast("int")


def windows(sections: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Replaces ``section`` by its windows: ``window_ix``, ``word_offset``, ``content``. At least 20 words a
    window; the overlap is at most one less than that. Sections without words have no windows."""
    most = max(20, max_words)
    overlap = max(0, min(overlap, most - 1))
    step = most - overlap
    words = F.filter(F.split("section", r"\s+"), lambda w: w != "")
    base = sections.withColumn("_w", words).withColumn("_n", window_count(F.size("_w"), most, overlap)).where("_n > 0")
    each = base.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("window_ix")).withColumn("word_offset", F.col("window_ix") * step)
    return each.withColumn("content", F.array_join(F.slice("_w", F.col("word_offset") + 1, most), " ")).drop("section", "_w", "_n")


def chunks(sections: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(id, document_id, url, title, heading, content, section_ix, window_ix, and the documents' other columns)."""
    other = [c for c in sections.columns if c not in ("id", "url", "title", "heading", "content", "section", "section_ix")]
    cut = windows(sections.withColumnRenamed("id", "document_id").drop("content"), max_words, overlap)
    return cut.select(chunk_id(F.col("document_id"), F.col("heading"), F.col("word_offset")).alias("id"), "document_id", "url", "title", "heading", "content", "section_ix", "window_ix", *other)
