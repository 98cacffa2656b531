"""Rewrites: compaction ladder, finalisation, key deletion, garbage collection."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import fill
from spindrift.sources import files

from .catalog import Catalog, Conflict, Hypertable, Lease, LeaseLost, Part
from .identity import compaction_identity, delete_key_identity
from .writer import write


@dataclass(frozen=True)
class Policy:
    l0_fanout: int = 4
    fanout: int = 10
    finalize_after: float = 3600.0
    lease_ttl: float = 60.0
    renew_every: float = 20.0
    candidates: int = 64


def partition_values(partition: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in partition.split("/")) if partition else {}


def rows_of(spark: SparkSession, ht: Hypertable, parts: Sequence[Part]) -> DataFrame:
    """Rows of parts of one partition, brought up to today's schema: missing columns null, expressions anew."""
    df = fill(files.read_parts(spark, [p.path for p in parts], ht.columns.physical), ht.columns)
    for name, value in partition_values(parts[0].partition).items():
        df = df.withColumn(name, F.lit(None if value == "None" else value)) if name not in df.columns else df
    return df


def eligible_level(parts: Sequence[Part], policy: Policy) -> int | None:
    """The lowest level with enough runs; a run is what one commit created."""
    for level in sorted({p.level for p in parts}):
        runs = len({p.commit for p in parts if p.level == level})
        if runs >= (policy.l0_fanout if level == 0 else policy.fanout):
            return level
    return None


def misordered(spark: SparkSession, ht: Hypertable, parts: Sequence[Part]) -> list[str]:
    """Paths of parts whose rows are not in sort order: nothing may rely on their order then."""
    from pyspark.sql import Window

    if not parts:
        return []
    rows = spark.read.schema(ht.columns.physical).parquet(*[p.path for p in parts]).select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    # Files are bounded by the placement's target, so a window over one of them is too.
    now, before = F.struct(*ht.sort_key), F.lag(F.struct(*ht.sort_key)).over(Window.partitionBy("__path").orderBy("__row"))
    return [r[0] for r in rows.withColumn("__before", before).where(F.col("__before").isNotNull() & (now < F.col("__before"))).select("__path").distinct().collect()]


class Compactor:
    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, owner: str = "compactor", policy: Policy = Policy()):
        self.spark, self.catalog, self.root, self.owner, self.policy = spark, catalog, root, owner, policy
        self._after: dict[tuple[int, str], str] = {}

    def _merge(self, ht: Hypertable, parts: Sequence[Part], level: int, lease: Lease) -> bool:
        """Replace `parts` by one run at `level`, renewing the lease meanwhile.  False: someone was first."""
        identity = compaction_identity(ht.id, [p.id for p in parts], level)
        if self.catalog.lookup(identity) is not None:
            return False
        ended, lost = threading.Event(), threading.Event()

        def renew() -> None:
            while not ended.wait(self.policy.renew_every):
                try:
                    self.catalog.renew_lease(lease, self.policy.lease_ttl)
                except LeaseLost:
                    lost.set()
                    self.spark.sparkContext.cancelJobsWithTag(tag)
                    return

        tag = f"merge-{lease.generation}"
        self.spark.sparkContext.addJobTag(tag)
        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            rows = sum(p.rows for p in parts)
            made = write(self.spark, self.catalog, ht, self.root, rows_of(self.spark, ht, parts), level, sum(p.bytes for p in parts) / max(rows, 1))
            return self.catalog.commit(ht.id, made, [p.id for p in parts], identity, lease=lease).applied
        except (Conflict, LeaseLost):
            return False
        except Exception:
            if lost.is_set():
                return False
            raise
        finally:
            ended.set()
            self.spark.sparkContext.removeJobTag(tag)

    def _with_lease(self, ht: Hypertable, partition: str, act) -> bool:
        lease = self.catalog.acquire_lease(ht.id, partition, self.owner, self.policy.lease_ttl)
        if lease is None:
            return False
        try:
            return act(lease)
        finally:
            self.catalog.release_lease(lease)

    def _ladder(self, ht: Hypertable, partition: str, lease: Lease) -> bool:
        parts = self.catalog.live_parts(ht.id, partition=partition)
        level = eligible_level(parts, self.policy)
        return level is not None and self._merge(ht, [p for p in parts if p.level == level], level + 1, lease)

    def _single(self, ht: Hypertable, partition: str, lease: Lease) -> bool:
        parts = self.catalog.live_parts(ht.id, partition=partition)
        return len({p.commit for p in parts}) >= 2 and self._merge(ht, parts, max(p.level for p in parts) + 1, lease)

    def _sweep(self, ht: Hypertable, kind: str, found: list[str], act) -> int:
        done = 0
        for partition in found:
            done += self._with_lease(ht, partition, lambda lease, p=partition: act(ht, p, lease))
            self._after[ht.id, kind] = partition
        return done

    def compact_once(self, hypertable: str | int) -> int:
        """One merge for each eligible partition, starting behind the last sweep's end; the cursor follows."""
        ht = self.catalog.hypertable(hypertable)
        head = self.catalog.feed_head(ht.id)
        found = self.catalog.compaction_candidates(ht.id, self.policy.l0_fanout, self.policy.fanout, self.owner, self._after.get((ht.id, "ladder"), ""), self.policy.candidates)
        done = self._sweep(ht, "ladder", found, self._ladder)
        self.catalog.set_cursor(self.owner, ht.id, head)
        return done

    def finalize_once(self, hypertable: str | int) -> int:
        """Quiet partitions of several runs become one run, a level above."""
        ht = self.catalog.hypertable(hypertable)
        found = self.catalog.finalize_candidates(ht.id, self.policy.finalize_after, self.owner, self._after.get((ht.id, "final"), ""), self.policy.candidates)
        return self._sweep(ht, "final", found, self._single)


def delete_key(spark: SparkSession, catalog: Catalog, root: str, hypertable: str | int, key: int, tries: int = 5) -> int:
    """Remove all rows of a key in one commit; the number of parts touched (0: none had it).

    Parts that hold nothing else are dropped; others are rewritten without it at their level.  It takes no
    lease: a compaction that was first makes it look again.
    """
    ht = catalog.hypertable(hypertable)
    for left in range(tries - 1, -1, -1):
        parts = catalog.live_parts(ht.id, key)
        if not parts:
            return 0
        made: list[Part] = []
        packed = [p for p in parts if not p.key_min == p.key_max == key]
        for level, partition in sorted({(p.level, p.partition) for p in packed}):
            mine = [p for p in packed if (p.level, p.partition) == (level, partition)]
            rows = rows_of(spark, ht, mine).where(~F.col(ht.packing_key).eqNullSafe(F.lit(key)))
            made += write(spark, catalog, ht, root, rows, level, sum(p.bytes for p in mine) / max(sum(p.rows for p in mine), 1))
        try:
            catalog.commit(ht.id, made, [p.id for p in parts], delete_key_identity(ht.id, key, [p.id for p in parts]))
            return len(parts)
        except Conflict:
            if not left:
                raise
    return 0


@dataclass(frozen=True)
class Retention:
    tombstone_grace: float = 900.0
    orphan_grace: float = 3600.0

    def check(self, statement_timeout: float) -> None:
        """A running statement may still read what was removed when it began."""
        if statement_timeout >= self.tombstone_grace:
            raise ValueError("the statement timeout must be shorter than the tombstone grace")


def collect_garbage(spark: SparkSession, catalog: Catalog, root: str, retention: Retention = Retention(), reconcile: bool = False) -> dict[str, int]:
    """Delete files of removed parts and of uploads that were never committed; by listing too if asked.

    A file is deleted first and its row stamped after, so that a crash repeats the deletion; rows stay for
    the feed.
    """
    done = {"reaped": 0, "orphans": 0, "unknown": 0}
    for part in catalog.reapable(retention.tombstone_grace):
        files.delete(spark, part.path)
        catalog.mark_purged(part.id)
        done["reaped"] += 1
    for path in catalog.orphans(retention.orphan_grace):
        files.delete(spark, path)
        catalog.clear_pending([path])
        done["orphans"] += 1
    if reconcile:
        for ht in catalog.hypertables():
            known = catalog.known_paths(ht.id)
            for path, (_, at) in files.listing(spark, f"{root}/ht/{ht.id}").items():
                if path not in known and not any(path.startswith(k + "/") or k.split(":", 1)[-1].lstrip("/") in path for k in known) and at <= catalog.clock() - retention.orphan_grace:
                    files.delete(spark, path)
                    done["unknown"] += 1
    return done
