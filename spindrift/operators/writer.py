"""DataFrame to sorted Parquet parts with the statistics that prune them."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spindrift.sources import files

from . import keyfilter
from .catalog import Catalog, Hypertable, Part

ROW_GROUP = 131_072
PACKED_BYTES = 1 << 30  # a packed part of more is cut between keys
SORT_BYTES = 1 << 28  # memory of the rows of one file while a task sorts them; a file of more is cut too
TILES = 256  # most files that one key of one partition is cut into at once


def day(column: str) -> F.Column:
    """UTC day of epoch milliseconds, as text."""
    return F.date_format(F.timestamp_millis(F.col(column)), "yyyy-MM-dd")


def partition_text(row, names: Sequence[str]) -> str:
    return "/".join(f"{n}={row[n]}" for n in names)


def sort_width(df: DataFrame) -> F.Column:
    """Bytes that a row takes while it is sorted: its fields, its texts, its chunk and its share of the sort's array."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * (len(df.columns) + len(texts)) + 72)).cast("long")


def placed(df: DataFrame, ht: Hypertable, bytes_per_row: float) -> tuple[DataFrame, int, DataFrame]:
    """`df` with `__chunk`, the file of its partition that a row goes to, and `__task`, the task that writes this file;
    the number of tasks; and the plan behind both, cached until the rows are written.

    Placement 0: one file a key.  Else files are cut between keys at the target size, or where sorting them would
    take more than `SORT_BYTES`; a key over that gets files of its own, tiled along time, that no other key shares.
    A task has one file of these, so its memory does not grow with the table.
    """
    parts, key, separate = list(ht.partition_by), ht.packing_key, ht.placement == 0
    target = max(1.0, (ht.placement or PACKED_BYTES) / max(bytes_per_row, 1e-9))  # rows
    row = F.xxhash64(*[F.col(f"d.{c}") for c in df.columns])
    along = F.col(f"d.{ht.time}") if ht.time else row
    # Time cuts come from a mergeable sketch, never from sorting one key in one task.
    cuts = F.percentile_approx(along, [k / TILES for k in range(1, TILES)], 4 * TILES)
    # Rows weigh more where their sort and not their file is what fills up first.
    rows = F.greatest(F.count("*"), F.ceil(F.sum(sort_width(df)) * F.lit(target / SORT_BYTES)))
    sizes = df.alias("d").groupBy(*parts, key).agg(rows.alias("__rows"), cuts.alias("__cuts"))
    whale = F.col("__rows") > target
    files = F.when(whale & F.lit(not separate), F.least(F.ceil(F.col("__rows") / target), F.lit(TILES))).otherwise(1).cast("int")
    before = Window.partitionBy(*parts).orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    small = F.when(whale, 0).otherwise(F.col("__rows"))
    plan = sizes.select(
        *parts,
        F.col(key).alias("__key"),
        files.alias("__files"),
        # Of the sketch's cuts only those between files: every row of the key is held against them.
        F.when(whale & F.lit(not separate), F.transform(F.sequence(F.lit(1), files - 1), lambda k: F.element_at("__cuts", F.ceil(k * TILES / files).cast("int")))).alias("__cuts"),
        whale.alias("__whale"),
        F.floor(F.coalesce(F.sum(small).over(before), F.lit(0)) / target).alias("__run"),
        # A whale's files come after the run that it interrupts and before the next.
        F.coalesce(F.sum(F.when(whale, files + 1).otherwise(0)).over(before), F.lit(0)).alias("__whales"),
    ).persist()
    last = F.max(F.col("__run") + F.col("__whales") + F.when(F.col("__whale"), F.col("__files")).otherwise(0))
    found = plan.groupBy(*parts).agg(last.alias("__last")).where("__last is not null").collect()  # a row for each partition
    first = [0, *itertools.accumulate(r["__last"] + 1 for r in found)]
    bases = df.sparkSession.createDataFrame([(*r[:-1], n) for r, n in zip(found, first, strict=False)], StructType([*plan.select(*parts).schema, StructField("__base", LongType())]))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in parts]
    plan_at = plan.alias("p").join(F.broadcast(bases).alias("b"), same or F.lit(True)).select("p.*", "b.__base")
    # Rows of one time that lies on a cut are spread over the files on both sides.
    tied = F.size(F.filter("__cuts", lambda c: c == along))
    tile = F.size(F.filter("__cuts", lambda c: c < along)) + F.when(tied > 0, F.pmod(row, tied + 1)).otherwise(0)
    at = F.when(F.col("__whale"), F.lit(0) if separate else tile)
    chunk = F.col(f"d.{key}").cast("string") if separate else F.when(F.col("__whale"), F.concat(F.lit("w"), F.col(key), F.lit("."), at)).otherwise(F.concat(F.lit("p"), F.col("__whales"), F.lit("."), F.col("__run")))
    task = F.col("__base") + F.col("__run") + F.col("__whales") + F.coalesce(at + 1, F.lit(0))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in parts] + [F.col(f"d.{key}").eqNullSafe(F.col("p.__key"))]
    return df.alias("d").join(plan_at.alias("p"), on).select("d.*", chunk.alias("__chunk"), task.cast("int").alias("__task")), max(first[-1], 1), plan


def write(spark: SparkSession, catalog: Catalog, ht: Hypertable, root: str, df: DataFrame, level: int = 0, bytes_per_row: float | None = None) -> list[Part]:
    """Write physical rows (with the partition columns) as parts; nothing is visible before a commit.

    The folder is fresh and registered as an intent first, so that a crash leaves a known orphan.
    """
    folder = f"{root}/ht/{ht.id}/L{level}/{uuid.uuid4().hex}"
    catalog.register_pending(ht.id, [folder])
    # Kept from being folded: a constant would drop out of the order below, and the writer would sort anew.
    opaque = {c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in ht.partition_by}
    chunked, tasks, plan = placed(df, ht, bytes_per_row or 64.0)
    try:
        order = [F.col(c).asc_nulls_first() for c in ht.sort_key]
        spread = [F.col(c) for c in (*ht.partition_by, "__chunk")]
        out = chunked.withColumns(opaque).repartitionById(tasks, F.col("__task")).drop("__task").sortWithinPartitions(*spread, *order)
        writer = out.write.partitionBy(*ht.partition_by, "__chunk").option("compression", "zstd" if level else "snappy").option("parquet.block.row.count.limit", ROW_GROUP)
        for c in ht.columns.columns:
            if c.bloom:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
        writer.parquet(folder)
    finally:
        plan.unpersist()
    parts = describe(spark, ht, folder, level)
    catalog.register_pending(ht.id, [p.path for p in parts])
    catalog.clear_pending([folder])
    return parts


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key set or Bloom filter of each file's keys."""
    for batch in batches:
        keys = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keyfilter.key_set(k) for k in keys], pa.list_(pa.int64())), pa.array([keyfilter.bloom(k) for k in keys], pa.binary())], names=["path", "keys", "bloom"])


def describe(spark: SparkSession, ht: Hypertable, folder: str, level: int) -> list[Part]:
    """Parts of a written folder, with the statistics that the files themselves give."""
    sizes = files.listing(spark, folder)
    if not sizes:
        return []
    key = ht.packing_key
    rows = spark.read.option("basePath", folder).parquet(folder).withColumn("__path", F.col("_metadata.file_path"))
    for c in ht.partition_by:
        rows = rows.withColumn(c, F.col(c).cast("string"))
    ints = [f.name for f in ht.columns.physical if f.dataType == LongType()]
    stats = [s for c in ints for s in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    found = rows.groupBy("__path", *ht.partition_by).agg(F.count("*").alias("__rows"), *stats)
    keys = rows.select("__path", key).distinct()
    few = keys.groupBy("__path").agg(F.count("*").alias("n")).where(F.col("n").between(2, keyfilter.BLOOM_LIMIT))
    held = keys.join(few, "__path").groupBy("__path").agg(F.collect_list(key).alias("keys")).mapInArrow(_indexed, "path string, keys array<long>, bloom binary")
    indexes = {r["path"]: (r["keys"], r["bloom"]) for r in held.collect()}  # a set or a filter for each file
    out = []
    for r in found.collect():  # a row for each file
        columns = {c: {"min": r[f"lo_{c}"], "max": r[f"hi_{c}"]} for c in ints}
        exact, bloom = indexes.get(r["__path"], (None, None))
        path = next((p for p in sizes if p.split(":", 1)[-1].lstrip("/") == r["__path"].split(":", 1)[-1].lstrip("/")), r["__path"])
        out.append(Part(path, partition_text(r, ht.partition_by), r[f"lo_{key}"], r[f"hi_{key}"], r["__rows"], sizes[path][0], level, {"columns": columns, **({"keys": exact} if exact else {})}, bytes(bloom) if bloom else None))
    return sorted(out, key=lambda p: p.path)
