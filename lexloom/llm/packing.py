"""Problem 8: filling containers of fixed capacity with whole items (sum-of-squares online packing).

Each item goes to the fill level that makes the sum over levels of the squared number of partly filled
containers least. Only a level array and, by level, the open containers are kept, so an item costs one
pass over the levels. Items are spread over shards by a hash of their id; every shard packs by itself
and shards grow in number, not in size, with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "item_id long, piece_ix int, container string, tokens int"


class Packer:
    """One shard's open containers. ``place`` returns the number of the container that takes the item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        cap, n = self.capacity, self.levels
        # Moving a container from level h to h + size changes the sum of squares by 2 (n[h+size] - n[h] + 1);
        # a new container by 2 n[size] + 1; full ones no longer count.
        level, cost = 0, (2 * n[size] + 1 if size < cap else 0)
        if size < cap:
            now, then = n[1 : cap - size + 1], n[size + 1 : cap + 1]
            change = np.where(now > 0, 2 * (then - now) + 2, np.iinfo(np.int64).max)
            if now[-1] > 0:
                change[-1] = 1 - 2 * now[-1]
            best = int(change.argmin())
            if change[best] < cost:
                level = best + 1
        if level:
            box = self.open[level].pop()
            n[level] -= 1
        else:
            box, self.made = self.made, self.made + 1
        if level + size < cap:
            n[level + size] += 1
            self.open.setdefault(level + size, []).append(box)
        return box


def pack(items: DataFrame, capacity: int = 2048, shard_items: int = 20_000) -> DataFrame:
    """``items(item_id, tokens)`` assigned to containers: (item_id, piece_ix, container, tokens).

    An item within the capacity is never split. A larger one fills containers of its own and its
    remainder is placed like an item; its pieces are numbered from 0. Items of null or no size hold
    nothing and are left out; repeated rows are items of their own; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shards = max(1, math.ceil(items.count() / shard_items))
    sized = items.select(F.col("item_id").cast("long"), F.col("tokens").cast("long")).where("tokens > 0")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "tokens"])
        packer, out, full = Packer(capacity), [], 0
        for item, tokens in zip(rows.item_id.tolist(), rows.tokens.tolist(), strict=True):
            whole, rest = divmod(tokens, capacity)
            for k in range(whole):
                out.append((item, k, f"{key[0]}f{full}", capacity))
                full += 1
            if rest:
                out.append((item, whole, f"{key[0]}o{packer.place(rest)}", rest))
        return pd.DataFrame(out, columns=["item_id", "piece_ix", "container", "tokens"])

    # By number, so that small shards aren't put together in one task: packing them takes time, not space.
    return sized.repartition(shards, "shard").groupBy("shard").applyInPandas(fill, PACKED)


def usage(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens in them, and the share of their space in use (null without containers)."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    one = boxes.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return one.withColumn("used", F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.lit(capacity)))
