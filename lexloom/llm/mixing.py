"""Problem 9: mixing sources to target weights (min-cost flow over membership patterns).

A text belongs to every source that holds a copy of it. Documents are aggregated by the set of sources
their text belongs to; the flow sends tokens from these patterns to the sources' quotas. Every further use
of the same texts, through whichever source, costs more than the one before (convex), so repetition is
spread and comes last. Only pattern totals reach the driver, as many as there are combinations of sources
that share texts. Documents are then drawn in an order fixed by a seed until the flow of their pattern and
source is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.scan import range_layout, running_sum
from lexloom.operators.skew import skew_join
from lexloom.runtime import materialize


def source_key(name: Column | str) -> Column:
    """Names equal but for case, outer blanks, or ``-``, ``_`` and blank between words get one key."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"[-_\s]", "_")


class Flow:
    """Max-flow by level graphs and blocking flows (Dinic), on which costs are laid level by level."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, start: int) -> list[int]:
        far = [-1] * len(self.out)
        far[start], ring = 0, [start]
        while ring:
            wave = []
            for a in ring:
                for e in self.out[a]:
                    if self.room[e] > 0 and far[self.to[e]] < 0:
                        far[self.to[e]] = far[a] + 1
                        wave.append(self.to[e])
            ring = wave
        return far

    def run(self, start: int, end: int) -> None:
        while (far := self.levels(start))[end] >= 0:
            at = [0] * len(self.out)  # next edge of each node that may still lead on
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(k for k, e in enumerate(path) if not self.room[e])
                    node = self.to[path[cut] ^ 1]
                    del path[cut:]
                while at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    if self.room[e] > 0 and far[self.to[e]] == far[node] + 1:
                        path.append(e)
                        node = self.to[e]
                        break
                    at[node] += 1
                else:
                    if node == start:
                        break
                    e = path.pop()
                    node = self.to[e ^ 1]
                    at[node] += 1


def plan_flow(patterns: dict[tuple[str, ...], tuple[int, dict[str, int]]], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each of its sources: as much of the quotas as the repeat caps
    allow, with as little repetition of a text as possible.

    ``patterns``: by sorted source names, the tokens of its distinct texts and of its rows in each source.
    The first use of the texts is free, the next costs one a token, the next two. A path's only cost is
    that of the use it begins with, so opening the uses one after another and filling each up gives the
    least cost.
    """
    names = sorted(quotas)
    own = [(p, t, {s: n * max(0, repeats[s]) for s, n in rows.items() if s in quotas}) for p, (t, rows) in sorted(patterns.items()) if t > 0]
    own = [x for x in own if sum(x[2].values()) > 0]
    at = {s: 1 + len(own) + k for k, s in enumerate(names)}
    end = 1 + len(own) + len(names)
    flow, edges, first = Flow(end + 1), {}, []
    for k, (p, _, rooms) in enumerate(own, 1):
        first.append(flow.edge(0, k, 0))
        for s, room in sorted(rooms.items()):
            edges[p, s] = flow.edge(k, at[s], room)
    for s in names:
        flow.edge(at[s], end, max(0, quotas[s]))
    for use in range(max((-(-sum(rooms.values()) // t) for _, t, rooms in own), default=0)):
        for e, (_, t, rooms) in zip(first, own, strict=True):
            flow.room[e] += max(0, min(t, sum(rooms.values()) - use * t))
        flow.run(0, end)
    return {ps: flow.room[e ^ 1] for ps, e in edges.items() if flow.room[e ^ 1] > 0}


def members(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, source, text_key, tokens)`` with ``sources``: all sources whose documents hold a
    text of the same key. A null source belongs nowhere, and a null key is a text of its own."""
    known = documents.where("text_key IS NOT NULL AND source IS NOT NULL")
    held = known.groupBy("text_key").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("_copies"))
    shared = materialize(held.where(F.size("sources") > 1), "shared")
    got = skew_join(documents, shared, ["text_key"], "left", size="_copies").drop("_copies")
    return got.withColumn("sources", F.coalesce("sources", F.array_compact(F.array("source"))))


def _pattern(keys: list[str]) -> Column:
    """The target sources among a document's, sorted."""
    texts = "array<string>"
    return F.array_sort(F.array_intersect(F.coalesce("sources", F.array().cast(texts)), F.array(*[F.lit(k) for k in keys]).cast(texts)))


def mix_plan(sized: DataFrame, targets: DataFrame) -> tuple[list[tuple], int]:
    """Per target source (source, key, target share, quota, tokens held, tokens given, flows by pattern),
    and the tokens of all rows.

    ``sized(doc_id, source, text_key, sources, tokens)`` comes from ``members``, materialized;
    ``targets(source, target_share, max_repeats)``. Quotas are shares of the tokens of all rows, also of
    those in no target source. Null sources count in that total only. A target without documents is given
    nothing. Target rows that name one source twice, or a null source, are an error.
    """
    want = [r.asDict() for r in targets.select(source_key("source").alias("key"), "source", "target_share", "max_repeats").collect()]
    keys = [w["key"] for w in want]
    if len(set(keys)) != len(keys) or None in keys:
        raise ValueError("target sources must be distinct and not null")
    rows_of = sized.select("text_key", "source", _pattern(keys).alias("pattern"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    held = rows_of.groupBy("pattern", "source").agg(F.sum("tokens").alias("tokens"))
    # Only texts under several sources have several rows to count once; all others are their own.
    several = rows_of.where(F.size("pattern") > 1).groupBy("pattern", "text_key").agg(F.max("tokens").alias("tokens")).groupBy("pattern").agg(F.sum("tokens").alias("texts"))
    texts = {tuple(r.pattern): int(r.texts) for r in several.collect()}
    patterns: dict[tuple[str, ...], tuple[int, dict[str, int]]] = {}
    total = 0
    for r in held.collect():
        total += int(r.tokens)
        if r.pattern and r.source in r.pattern:
            p = tuple(r.pattern)
            rows = patterns.setdefault(p, (texts.get(p, 0), {}))[1]
            rows[r.source] = int(r.tokens)
    patterns = {p: (t or sum(rows.values()), rows) for p, (t, rows) in patterns.items()}
    quotas = {w["key"]: round(float(w["target_share"] or 0) * total) for w in want}
    given = plan_flow(patterns, quotas, {w["key"]: int(w["max_repeats"] or 0) for w in want})
    by_source: dict[str, dict] = {k: {} for k in keys}
    for (p, s), f in given.items():
        by_source[s][p] = f
    own = dict.fromkeys(keys, 0)
    for _, rows in patterns.values():
        for s, n in rows.items():
            own[s] += n
    return [(w["source"], w["key"], float(w["target_share"] or 0), quotas[w["key"]], own[w["key"]], sum(by_source[w["key"]].values()), by_source[w["key"]]) for w in want], total


def draw(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """The mixture: (source, doc_id, tokens, uses); a document is used whole, ``uses`` times.

    ``sized`` as for ``mix_plan``. Within a pattern and source the documents stand in an order fixed by ``seed``; each is used as often
    as the flow covers the pattern whole, and the first ones, up to what is left of the flow, once more.
    """
    spark = sized.sparkSession
    rows, _ = mix_plan(sized, targets)
    plan = [(source, list(p), f, key) for source, key, *_, flows in rows for p, f in flows.items()]
    schema = "name string, pattern array<string>, flow long, source string"
    keys = [r[1] for r in rows]
    # As many rows as patterns times their sources; Spark decides by its size whether it is broadcast.
    flows = spark.createDataFrame(plan, schema)
    docs = sized.where("tokens > 0").select("doc_id", "tokens", "source", _pattern(keys).alias("pattern"))
    docs = skew_join(docs, flows, ["pattern", "source"]).withColumn("_at", F.xxhash64("doc_id", "source", F.lit(seed))).drop("source").withColumnRenamed("name", "source")
    order = ["_at", "doc_id"]
    docs = materialize(docs.select("source", F.concat_ws("\u0001", "pattern").alias("pattern"), "flow", "doc_id", "tokens", "_at"), "drawn")
    laid = range_layout(docs, ["source", "pattern"], order, ready=True)
    whole = laid.groupBy("source", "pattern").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("_n"))
    got = materialize(running_sum(laid, ["source", "pattern"], order, F.col("tokens"), "upto"), "upto")
    got = skew_join(got, whole, ["source", "pattern"], size="_n")
    full = F.floor(F.col("flow") / F.col("held"))
    uses = full + (F.col("upto") <= F.col("flow") - full * F.col("held")).cast("long")
    return got.select("source", "doc_id", "tokens", uses.alias("uses")).where("uses > 0")


def shares(drawn: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source its target share, the share it reached of all tokens wanted, and of the mixture."""
    rows, total = mix_plan(sized, targets)
    plan = sized.sparkSession.createDataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in rows], "source string, target_share double, quota long, held_tokens long, flow_tokens long")
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("drawn_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    got = plan.join(used, "source", "left").na.fill(0, ["drawn_tokens", "documents", "most_uses"])
    every = got.agg(F.sum("drawn_tokens").alias("_all"))
    return got.join(F.broadcast(every)).select("source", "target_share", "quota", "held_tokens", "drawn_tokens", "documents", "most_uses", (F.col("drawn_tokens") / F.lit(max(total, 1))).alias("share_of_all"), (F.col("drawn_tokens") / F.greatest(F.col("_all"), F.lit(1))).alias("share_of_mixture"))
