"""Problem 3: one order from several differently scaled scores (outranking net flow).

For every score the items of a group are put on percentiles. An item is preferred to another not at all
while its percentile is no more than ``indifference`` higher, fully from ``preference`` on, and in
proportion between. What an item is preferred by minus what others are preferred to it, over all others
and weighted over the scores, is its net flow. Counts and sums of the percentiles up to the four places
at the thresholds' distances give it exactly, without pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.multiindex import cosine_of, usable
from lexloom.operators.scan import range_layout, running_sum
from lexloom.operators.skew import skew_join
from lexloom.runtime import materialize

# Differences of percentiles that count for nothing, and from which on preference is full.
INDIFFERENCE, PREFERENCE = 0.05, 0.5


def net_flows(items: DataFrame, group: list[str], item: list[str], scores: dict[str, float], indifference: float = INDIFFERENCE, preference: float = PREFERENCE) -> DataFrame:
    """(group, item, net_flow) of ``items(group, item, one column a score)``, one row an item.

    ``scores`` names the score columns and their weights; the thresholds are shares of the percentile
    scale, 0 <= indifference < preference. A null or NaN score is the group's lowest, below all others and
    equal among themselves; equal scores share the middle of their percentiles. A group of one item has
    flow 0; rows with a null in the group are left out. An empty table gives no rows.
    """
    if not 0 <= indifference < preference:
        raise ValueError("indifference must be at least 0 and less than preference")
    weights = F.create_map(*[x for name, w in scores.items() for x in (F.lit(name), F.lit(float(w)))])
    lowest = F.lit(float("-inf"))
    value = lambda name: F.when(F.isnan(name) | F.col(name).isNull(), lowest).otherwise(F.col(name).cast("double") + F.lit(0.0))
    known = items.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group]))
    long = known.select(*group, *item, F.explode(F.array(*[F.struct(F.lit(n).alias("_by"), value(n).alias("_value")) for n in scores])).alias("_s")).select(*group, *item, "_s._by", "_s._value")
    # Values are counted before they are ordered, so a value that a third of the rows share is one row.
    keys = [*group, "_by"]
    counts = materialize(long.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_same")), "values")
    sizes = counts.groupBy(*keys).agg(F.sum("_same").alias("_size"), F.count(F.lit(1)).alias("_values"))
    upto = running_sum(range_layout(counts, keys, ["_value"], ready=True), keys, ["_value"], F.col("_same"), "_upto")
    placed = skew_join(materialize(upto.select(*keys, "_value", "_same", "_upto"), "places"), sizes, keys, size="_values")
    # Places are twice the middle rank, so the whole scale is twice the size less one.
    place = 2 * F.col("_upto") - F.col("_same") + 1
    far = 2 * (F.col("_size") - 1)
    shifts = [-preference, -indifference, indifference, preference]
    points = F.array(
        F.struct(place.cast("double").alias("_at"), F.lit(0).alias("_ask"), F.col("_same").alias("_n"), (place * F.col("_same")).alias("_sum")),
        *[F.struct((place + F.lit(d) * far).alias("_at"), F.lit(k).alias("_ask"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_sum")) for k, d in enumerate(shifts, 1)],
    )
    spread = placed.select(*keys, "_value", place.cast("double").alias("_place"), "_size", F.explode(points).alias("_p")).select(*keys, "_value", "_place", "_size", "_p.*")
    order = ["_at", "_ask", "_value"]
    laid = range_layout(spread, keys, order)
    summed = running_sum(running_sum(laid, keys, order, F.col("_n"), "_count"), keys, order, F.col("_sum"), "_total")
    at = lambda k, c: F.max(F.when(F.col("_ask") == k, F.col(c).cast("double")))
    wide = summed.where("_ask > 0").groupBy(*keys, "_value").agg(F.max("_place").alias("_place"), F.max("_size").alias("_size"), *[at(k, c).alias(f"{c}{k}") for k in (1, 2, 3, 4) for c in ("_count", "_total")])
    near, full, n = F.lit(2 * indifference) * (F.col("_size") - 1), F.lit(2 * preference) * (F.col("_size") - 1), F.col("_size")
    between = lambda a, b, c: F.col(f"{c}{b}") - F.col(f"{c}{a}")
    plus = F.col("_count1") + ((F.col("_place") - near) * between(1, 2, "_count") - between(1, 2, "_total")) / (full - near)
    minus = n - F.col("_count4") + (between(3, 4, "_total") - (F.col("_place") + near) * between(3, 4, "_count")) / (full - near)
    flow = F.when(n > 1, (plus - minus) / (n - 1)).otherwise(F.lit(0.0))
    flows = wide.select(*keys, "_value", (flow * weights[F.col("_by")]).alias("_flow")).join(counts, [*keys, "_value"])
    joined = skew_join(long, materialize(flows, "flows"), [*keys, "_value"], size="_same")
    return joined.groupBy(*group, *item).agg((F.sum("_flow") / F.lit(float(sum(scores.values())))).alias("net_flow"))


def candidates(scores: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, corpus, chunk, score_default, score_title_boost, cosine), one row a candidate.

    ``scores(query_id, corpus, chunk, profile, score, scored_at)``; of repeated rows the latest counts.
    The vector of a chunk is its latest usable one (right length, no NaN, not all zero); a candidate
    without one, or of a query without values, has a null cosine. Rows without query, corpus or chunk
    are left out.
    """
    keys = ["query_id", "corpus", "chunk"]
    known = scores.where("query_id IS NOT NULL AND corpus IS NOT NULL AND chunk IS NOT NULL")
    last = lambda p: F.max(F.when(F.col("profile") == p, F.struct("scored_at", "score")))["score"]
    wide = known.groupBy(*keys).agg(last("default").alias("score_default"), last("title_boost").alias("score_title_boost"))
    wide = materialize(wide, "scored")
    named = vectors.join(wide.select("corpus", "chunk").distinct(), ["corpus", "chunk"], "left_semi")
    own = usable(named).groupBy("corpus", "chunk").agg(F.max(F.struct("written_at", "vec_id", "unit"))["unit"].alias("_unit"))
    asked = queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.max(F.struct("asked_at", "query_values"))["query_values"].alias("_asked"))
    held = wide.groupBy("query_id").agg(F.count(F.lit(1)).alias("_held"))
    full = skew_join(wide, held.join(asked, "query_id", "left"), ["query_id"], "left", size="_held")
    full = skew_join(materialize(full, "asked"), own, ["corpus", "chunk"], "left")
    return full.select(*keys, "score_default", "score_title_boost", cosine_of("_asked", "_unit").alias("cosine"))


def rank_candidates(cands: DataFrame) -> DataFrame:
    """(query_id, corpus, chunk, net_flow) with the three scores weighing alike."""
    return net_flows(cands, ["query_id"], ["corpus", "chunk"], {"score_default": 1.0, "score_title_boost": 1.0, "cosine": 1.0})


def first_of_each(ranked: DataFrame) -> DataFrame:
    """The first candidate of every query; of equal flows the lowest corpus and chunk."""
    best = ranked.groupBy("query_id").agg(F.min(F.struct(F.round(-F.col("net_flow"), 9).alias("f"), "corpus", "chunk")).alias("b"))
    return best.select("query_id", "b.corpus", "b.chunk")
