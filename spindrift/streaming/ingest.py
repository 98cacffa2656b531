"""Exactly-once ingest of JSON records by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spindrift.functions.expressions import fill
from spindrift.operators.catalog import Catalog, CommitResult, Hypertable
from spindrift.operators.identity import OffsetRange, ingest_identity
from spindrift.operators.writer import day, write

FLUSH, DEFER = "flush", "defer"


@dataclass(frozen=True)
class IngestConfig:
    max_age_days: int = 3650
    max_future_secs: int = 3600
    max_rows: int = 100_000
    slowdown: int = 30
    stop: int = 200


def in_bounds(ts: int, now: int, cfg: IngestConfig = IngestConfig()) -> bool:
    """Event time (ms) not older or further ahead than allowed."""
    return now - cfg.max_age_days * 86_400_000 <= ts <= now + cfg.max_future_secs * 1000


def flush_decision(l0: int, deferred: int, rows: int, cfg: IngestConfig = IngestConfig()) -> str:
    """Whether to write now: never beyond `stop` parts, every other time beyond `slowdown`, and in any case
    with twice the buffer full."""
    if rows >= 2 * cfg.max_rows:
        return FLUSH
    if l0 >= cfg.stop:
        return DEFER
    if l0 >= cfg.slowdown and deferred == 0:
        return DEFER
    return FLUSH


def assignment(existing: Iterable[int], owned: Iterable[int] | None, stored: dict[int, int]) -> list[tuple[int, int]]:
    """Source partitions to read, with the offset to begin at: stored, or 0."""
    mine = set(existing) if owned is None else set(existing) & set(owned)
    return [(p, stored.get(p, 0)) for p in sorted(mine)]


def decode(raw: DataFrame, ht: Hypertable, now: int, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Physical rows of the records that can be kept, with `day`; poison is skipped.

    Skipped: no JSON, key or time absent or not an integer, time out of bounds.  A value of the wrong type in
    another column is null.  A null in a column that may not be null skips the row too.
    """
    schema = StructType([f for f in ht.columns.input])
    loose = StructType([type(f)(f.name, f.dataType, True) for f in schema])
    rows = raw.select(F.from_json("value", loose).alias("row")).where("row is not null").select("row.*").where(F.col(ht.packing_key).isNotNull())
    if ht.time:
        rows = rows.where(F.col(ht.time).between(now - cfg.max_age_days * 86_400_000, now + cfg.max_future_secs * 1000))
    for c in ht.columns.columns:
        if c.kind == "stored" and not c.nullable:
            rows = rows.where(F.col(c.name).isNotNull())
    rows = fill(rows, ht.columns)
    return rows.withColumn("day", day(ht.time)) if "day" in ht.partition_by and "day" not in rows.columns else rows


class Ingest:
    """Writes micro-batches of (topic, partition, offset, value) to a hypertable."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, hypertable: str | int, clock_ms, cfg: IngestConfig = IngestConfig(), relieve: Callable[[], object] | None = None):
        self.spark, self.catalog, self.root, self.cfg, self.clock_ms = spark, catalog, root, cfg, clock_ms
        self.ht = catalog.hypertable(hypertable)
        self.skipped, self.freshest, self.deferrals, self.relieve = 0, None, 0, relieve

    def _admit(self, rows: int) -> None:
        """Hold the source back while level 0 is too full: each deferral runs `relieve` (a compaction, or a wait)
        once.  Without `relieve`, or where it does not shrink level 0 any more, the batch is written all the same."""
        deferred, before = 0, None
        while self.relieve is not None:
            l0 = sum(p.level == 0 for p in self.catalog.live_parts(self.ht.id))
            if flush_decision(l0, deferred, rows, self.cfg) == FLUSH or l0 == before:
                return
            self.relieve()
            deferred, before = deferred + 1, l0
            self.deferrals += 1

    def batch(self, records: DataFrame, batch_id: int | None = None) -> CommitResult | None:
        """Commit one micro-batch: parts and offsets in one transaction, identified by the offsets.

        A replay of the same offsets changes nothing.  If every record is skipped the offsets still advance.
        The files of a replayed batch are known orphans until they are collected.
        """
        records = records.persist()
        try:
            seen = records.groupBy("topic", "partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count("*").alias("n")).collect()
            if not seen:
                return None
            ranges = [OffsetRange(r["topic"], r["partition"], r["lo"], r["hi"]) for r in seen]
            identity = ingest_identity(self.ht.id, ranges)
            if (done := self.catalog.lookup(identity)) is not None:
                return CommitResult(done, False)
            self._admit(sum(r["n"] for r in seen))
            parts = write(self.spark, self.catalog, self.ht, self.root, decode(records, self.ht, self.clock_ms(), self.cfg))
            result = self.catalog.commit(self.ht.id, parts, identity=identity, offsets=ranges)
            self.skipped += sum(r["n"] for r in seen) - sum(p.rows for p in parts)
            latest = [p.stats["columns"][self.ht.time]["max"] for p in parts if self.ht.time]
            self.freshest = max([x for x in (self.freshest, *latest) if x is not None], default=None)
            return result
        finally:
            records.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda df, batch_id: self.batch(df, batch_id) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def json_lines(spark: SparkSession, path: str, topic: str = "files") -> DataFrame:
    """A folder of JSON lines as a stream of records.

    A file is a source partition, numbered by a hash of its whole path, length and time of change (folders
    repeat names); a line's offset is its place by byte blocks of the file, which a replay finds again.
    """
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return spark.readStream.option("recursiveFileLookup", "true").text(path).select(F.lit(topic).alias("topic"), file.bitwiseAND((1 << 63) - 1).alias("partition"), F.col("_metadata.file_block_start").alias("offset"), "value")


def kafka(spark: SparkSession, servers: str, topic: str, catalog: Catalog, hypertable: int, partitions: Iterable[int], owned: Iterable[int] | None = None) -> DataFrame:
    """A Kafka topic from the catalog's offsets on (needs Spark's Kafka connector on the class path)."""
    import json

    stored = {p: n for (t, p), n in catalog.offsets(hypertable).items() if t == topic}
    at = {topic: {str(p): o for p, o in assignment(partitions, owned, stored)}}
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("assign", json.dumps({topic: [int(p) for p in at[topic]]})).option("startingOffsets", json.dumps(at)).load()
    return stream.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))
