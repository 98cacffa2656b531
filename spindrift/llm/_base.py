"""Shared plumbing: table access, staged tables in the shared checkpoint folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # temporary folders of sessions without a configured one, by application


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A local master without one (tests) gets a temporary folder; a cluster
    without one is refused, as its executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="spindrift-")
        _own[app] = at
    return at


ROWS = 1000  # of a batch that a Python worker is given


def small_batches(spark: SparkSession) -> None:
    """Keep the batches of long texts small: two workers share an executor's memory with its JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS:
        spark.conf.set(name, ROWS)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files go when the write is done, not when the driver's JVM next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread, not a recomputation.

    Removed by `discard`, or by the JVM when it ends, stopped sessions included.
    """
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with _shuffles_end(spark):
        df.write.parquet(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged tables whose last reader is done (what was made of them is staged itself)."""
    for df in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lean(run):
    """`run`, an iterator over batches, giving its memory back when it ends: workers are used again, and what
    one task freed would else stay with the process beside the executor's heap."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 16, cap: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal values in the first column (sorted), and where runs begin and end.

    Tables have about `most` rows, or one run that is longer; a run of `cap` rows or more comes in pieces.
    """
    held: list[pa.RecordBatch] = []
    rows, wait = 0, most

    def table() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.asarray(t.column(0))
        return t, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wait:
            continue
        t, cut = table()
        wait = most
        if len(cut) > 2:
            last = int(cut[-2])
            yield t.slice(0, last).combine_chunks(), cut[:-1]
            held, rows = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
        elif cap and rows >= cap:
            yield t, cut
            held, rows = [], 0
        else:
            held, wait = t.to_batches(), 2 * rows
    if held:
        yield table()


LINKS = 1_000_000  # so many links are solved in one task


def _forest(batches):
    """Components of all links that this task is given, by union-find with path halving."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b", most: int = LINKS) -> DataFrame:
    """Connected components of undirected links.

    Up to `LINKS` links are solved in one task of bounded memory, more by alternating large-star and
    small-star over all of them; both give the same rows.
    Returns (node, component): component is the smallest node reachable.  Every node of a link is in the
    result.  A hub costs one row a neighbour; minima are combined before they are shuffled.
    """
    edges = staged(spark, links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= most:
        return edges.coalesce(1).mapInArrow(_forest, "node long, component long")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = staged(spark, both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = staged(spark, small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now
