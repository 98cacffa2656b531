"""Sharding by Hilbert-curve ordering.

Metadata dimensions are quantised to `BITS` bits each, mapped to their index on a Hilbert curve, and the
rows sorted by it; shards are runs of that order, so that a file holds a compact cell of all dimensions and
min/max statistics prune on each of them.  Law `rows`: the row counts of two shards differ by one at most.
The rank of a row is its place within its sorted range plus the sizes of the ranges before; only those
sizes (one number a partition) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import staged, table

BITS = 8


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (n x d, each under 2**bits): axes to transpose form, interleaved."""
    x = axes.T.astype(np.int64).copy()
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of each level
        low = q - 1
        for k in range(d):
            hit = (x[k] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, d):  # Gray code
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            out = (out << 1) | ((x[k] >> bit) & 1)
    return out


def number_axis(c: Column, low: float, high: float) -> Column:
    """A number quantised evenly between the table's bounds; null is 0."""
    top = (1 << BITS) - 1
    return F.coalesce(F.least(F.lit(top), F.floor((c - low) * (top / (high - low)) if high > low else F.lit(0))), F.lit(0)).cast("int")


def log_axis(c: Column) -> Column:
    """A size quantised by its logarithm, 12 steps a doubling; null is 0."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1) * 12)).cast("int")


def name_axis(c: Column) -> Column:
    """A name hashed to a cell, equal names together; null is 0."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << BITS))).cast("int")


def ranked(spark: SparkSession, rows: DataFrame, axes: Sequence[Column], ties: Sequence[str]) -> tuple[DataFrame, int]:
    """`rows` with `curve` and `rank` (gapless from 0 along the curve, then `ties`), and their number."""

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy()))

    on = rows.withColumn("curve", curve(F.struct(*[a.alias(f"x{k}") for k, a in enumerate(axes)])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on = staged(spark, on.repartitionByRange(parts, "curve", *ties).withColumn("piece", F.spark_partition_id()))
    sizes = sorted((r["piece"], r["count"]) for r in on.groupBy("piece").count().collect())
    before, total = [], 0
    for piece, n in sizes:
        before.append((piece, total))
        total += n
    start = spark.createDataFrame(before, "piece int, before long")
    place = F.row_number().over(Window.partitionBy("piece").orderBy("curve", *ties)) - 1
    return on.withColumn("place", place).join(F.broadcast(start), "piece").withColumn("rank", F.col("before") + F.col("place")).drop("piece", "place", "before"), total


def shards(spark: SparkSession, docs: DataFrame, count: int = 40) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    size is the UTF-8 bytes of the text (null: none) plus 16, text_crc32 that of the text (null: of no bytes).
    Dimensions: language, source, length and id.  Nulls lie in cell 0; ties go by id, then by crc; equal rows
    get neighbouring slots.  Fewer rows than shards: one each in as many shards as there are rows.  Other
    columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    axes = [name_axis(F.col("lang")), name_axis(F.col("source")), log_axis(F.col("bytes")), number_axis(F.col("doc_id"), low or 0, high or 0)]
    rows, total = ranked(spark, base, axes, ["doc_id", "text_crc32"])
    # Shard s holds the ranks from ceil(s * total / count) up to the next such bound.
    rows = rows.withColumn("shard", F.expr(f"int(rank * {count} div {max(total, 1)})"))
    slot = F.expr(f"rank - (shard * {total}L + {count - 1}) div {count}")
    return rows.select("doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, count: int = 40) -> None:
    """Write `docs` as `count` files in curve order under `path`/shard=N (ids must tell the rows apart)."""
    at = shards(spark, docs, count).select("doc_id", "shard", "slot")
    docs.join(at, "doc_id").repartition(count, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, table(spark, sf_dir, "documents"))
