"""Session helpers: table loading and cutting lineage through a folder every executor shares."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_written: dict[str, SparkSession] = {}
_pinned: set[str] = set()
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master, where one machine is all there is, gets a
    temporary folder where that is unset; on a cluster that is an error, as executors would not share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="lexloom-"))
    return where.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so later jobs neither repeat its
    plan nor depend on the executors that made it. The table is removed by ``release``, at the latest when
    the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> str:
    """``path``, a folder that goes as the tables of ``materialize`` do."""
    _written[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system; one that is not there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame | str) -> None:
    """Deletes tables written by ``materialize``: the given ones (by path or frame), else all of them."""
    files = [t if isinstance(t, str) else next(iter(t.inputFiles()), "") for t in tables]
    for path in [p for p in _written if not tables or any(p.rsplit("/", 1)[1] in f for f in files)]:
        _pinned.discard(path)
        try:
            delete(_written.pop(path), path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def pinned(make: Callable[[], T]) -> T:
    """What ``make`` gives, whose tables stay until they are released by name or the program ends."""
    before = set(_written)
    got = make()
    _pinned.update(p for p in _written if p not in before)
    return got


def scoped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, folder)`` that, called again for a folder, first deletes the tables its last call there
    wrote; so a long session keeps the tables of one run of every query at most."""
    last: dict[str, list[str]] = {}

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        if gone := last.pop(folder, None):
            release(*gone)
        before = set(_written)
        got = query(spark, folder)
        last[folder] = [p for p in _written if p not in before and p not in _pinned]
        return got

    return run


atexit.register(release)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
