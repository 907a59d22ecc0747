"""Multi-corpus index folders: manifest, stale corpora, shard packing."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import safe_name
from lexloom.operators.scan import PID, range_layout, running_sum
from lexloom.runtime import materialize, partitions

CONTENT_SHARD = 128 * 1024
# Seconds that a lock is waited for, and after which one counts as left behind.
LOCK_WAIT, LOCK_STALE = 60.0, 600.0


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on the shared file system, written over what is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


@contextmanager
def locked(spark: SparkSession, path: str | None, wait: float = LOCK_WAIT, stale: float = LOCK_STALE) -> Iterator[None]:
    """Holds a lock file while the body runs; one older than ``stale`` seconds is taken over. No path, no lock."""
    if path is None:
        yield
        return
    fs, p = _fs(spark, path)
    began = time.time()
    while True:
        try:
            fs.create(p, False).close()
            break
        except Exception:
            if not fs.exists(p):
                if time.time() - began > wait:
                    raise
            elif time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
                fs.delete(p, False)
            elif time.time() - began > wait:
                raise TimeoutError(f"{path} is held by another writer") from None
            else:
                time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(p, False)


def write_manifest(spark: SparkSession, root: str, corpora: dict[str, dict], built_at: str | None = None, version: int = 2) -> None:
    body = {"version": version, "built_at": built_at or datetime.now(UTC).isoformat(), "corpora": {safe_name(k): v for k, v in sorted(corpora.items())}}
    write_text(spark, f"{root}/manifest.json", json.dumps(body, indent=1))


def read_manifest(spark: SparkSession, root: str) -> dict:
    got = json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])
    if got.get("version") not in (1, 2) or not isinstance(got.get("corpora"), dict):
        raise ValueError(f"no manifest of a known format in {root}")
    return got


def stale_corpora(spark: SparkSession, root: str, configured: list[str]) -> list[str]:
    """Folders of the output that no configured corpus owns."""
    fs, p = _fs(spark, root)
    there = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(set(there) - {safe_name(c) for c in configured})


def remove_stale(spark: SparkSession, root: str, configured: list[str]) -> list[str]:
    gone = stale_corpora(spark, root, configured)
    for name in gone:
        fs, p = _fs(spark, f"{root}/{name}")
        fs.delete(p, True)
    return gone


def clean_corpus(spark: SparkSession, root: str, corpus: str) -> None:
    fs, p = _fs(spark, f"{root}/{safe_name(corpus)}")
    fs.delete(p, True)


def pack_shards(rows: DataFrame, order: list[str], size: str, target: int = CONTENT_SHARD) -> DataFrame:
    """Adds ``shard``: rows in order, put together until the next would pass the target size; a row is never
    split. The first of ``order`` is the corpus, in which shards are numbered from 0 without gaps.

    Where a range's first shard begins hangs on the ranges before it, so every range is packed once for each
    row that could begin it; those packings soon run together, and what is left of each range is a small table
    from the bytes it is entered with to those it is left with. The driver follows it from range to range.
    """
    key, names = order[0], rows.columns
    laid = range_layout(rows, [], order)

    def walk(sizes: list[int], groups: list, held: int, opens: bool) -> tuple[list[int], int]:
        """Whether each row begins a shard, and the bytes held in the last one."""
        begins = []
        for k, n in enumerate(sizes):
            new = opens if k == 0 else groups[k] != groups[k - 1]
            if new or held + n > target and held:
                begins.append(1)
                held = n
            else:
                begins.append(0)
                held += n
        return begins, held

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[int], list]]:
        at, sizes, groups = None, [], []
        for b in batches:
            for part, own in b.groupby("part", sort=True):
                if at is not None and part != at:
                    yield at, sizes, groups
                    sizes, groups = [], []
                at = part
                sizes += own[size].fillna(0).astype("int64").tolist()
                groups += own[key].tolist()
        if at is not None:
            yield at, sizes, groups

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sizes, groups in ranges(batches):
            # Entered with some bytes, the first shard that begins inside begins at one of these rows.
            upto, first = 0, []
            for k, n in enumerate(sizes):
                first.append(k)
                upto += n
                if upto > target or groups[k] != groups[0]:
                    break
            ends: dict[int, int] = {}  # by row that begins a shard, the bytes held at the range's end
            follow: dict[int, int] = {}
            for k in first:
                path, at = [], k
                while at < len(sizes) and at not in follow:
                    path.append(at)
                    held, j = sizes[at], at + 1
                    while j < len(sizes) and groups[j] == groups[at] and not (held + sizes[j] > target and held):
                        held += sizes[j]
                        j += 1
                    follow[at] = j
                    ends[at] = held if j == len(sizes) else -1
                    at = j
                for x in reversed(path):
                    if ends[x] < 0:
                        ends[x] = ends[follow[x]]
            yield pd.DataFrame({"part": [part], "keys": [[groups[0], groups[-1]]], "total": [sum(sizes)], "sizes": [[sizes[k] for k in first]], "same": [groups[0] == groups[-1]], "alike": [[groups[k] == groups[0] for k in first]], "ends": [[ends[k] for k in first]]})

    slim = laid.select(F.col(PID).alias("part"), key, size, *[c for c in order[1:] if c != size])
    slim = slim.repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("part", *order)
    kind = rows.schema[key].dataType.simpleString()
    tables = sorted(slim.mapInPandas(outcomes, f"part int, keys array<{kind}>, total long, sizes array<long>, same boolean, alike array<boolean>, ends array<long>").collect(), key=lambda r: r.part)
    entered, last, held = {}, None, 0
    for r in tables:
        opens = last is None or last != (r["keys"][0],)
        entered[r.part] = (0 if opens else held, opens)
        upto = 0 if opens else held
        begin = 0 if opens else None
        if not opens:
            for k, n in enumerate(r.sizes):
                if not r.alike[k] or upto + n > target and upto:
                    begin = k
                    break
                upto += n
        held = held + r.total if begin is None else r.ends[begin]
        last = (r["keys"][1],)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, (0, True, None)
        for b in batches:
            marks = []
            for part, n, group in zip(b.part.tolist(), b[size].fillna(0).astype("int64").tolist(), b[key].tolist(), strict=True):
                if part != at:
                    at, state = part, (*entered[part], group)
                held, opens, before = state
                new = opens or group != before or held + n > target and held
                marks.append(int(bool(new)))
                state = (n if new else held + n, False, group)
            yield b.drop(columns=["part"]).assign(part=b.part, begins=marks)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = laid.select(*names, F.col(PID).alias("part")).repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("part", *order)
    marked = materialize(placed.mapInPandas(mark, f"{schema}, part int, begins int").withColumnRenamed("part", PID), "marked")
    return running_sum(marked, [key], order[1:], F.col("begins"), "_upto").select(*names, (F.col("_upto") - 1).cast("int").alias("shard"))
