"""The catalog: tables, parts, atomic commits, change feed, leases, cursors, offsets and upload intents.

Metadata only, kept by the driver in SQLite (one serialised writer, so commit ids appear in order).  Executors
never touch it.  All times are seconds from an injectable clock.
"""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from spindrift.sources.schema import TableColumns, check_sort_key

from .identity import OffsetRange, OperationIdentity
from .pruning import ColumnRange, part_excluded


class CatalogError(Exception):
    """Base of the catalog's own errors."""


class NotFound(CatalogError):
    pass


class Conflict(CatalogError):
    """A part to be replaced or deleted is not live."""


class OffsetRace(CatalogError):
    """The offsets were consumed by someone else."""


class OperationKeyCollision(CatalogError):
    """One operation key, two intents."""


class LeaseLost(CatalogError):
    pass


@dataclass(frozen=True)
class Hypertable:
    id: int
    name: str
    columns: TableColumns
    partition_by: tuple[str, ...]
    sort_key: tuple[str, ...]
    packing_key: str
    time: str | None
    placement: int | None  # None: packed; 0: one file a key; n: files of about n bytes, cut between keys


@dataclass(frozen=True)
class Part:
    path: str
    partition: str
    key_min: int | None
    key_max: int | None
    rows: int
    bytes: int
    level: int = 0
    stats: dict | None = None
    key_bloom: bytes | None = None
    id: int | None = None
    commit: int | None = None


@dataclass(frozen=True)
class CommitResult:
    commit: int
    applied: bool  # False: the same operation had been committed before
    parts: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Lease:
    hypertable: int
    partition: str
    owner: str
    generation: int


_TABLES = """
CREATE TABLE IF NOT EXISTS hypertables (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT UNIQUE NOT NULL, schema TEXT NOT NULL,
    partition_by TEXT NOT NULL, sort_key TEXT NOT NULL, packing_key TEXT NOT NULL, time TEXT, placement INTEGER);
CREATE TABLE IF NOT EXISTS logical_tables (namespace INTEGER NOT NULL, name TEXT NOT NULL, hypertable INTEGER NOT NULL REFERENCES hypertables,
    column_mapping TEXT, PRIMARY KEY (namespace, name));
CREATE TABLE IF NOT EXISTS commits (id INTEGER PRIMARY KEY AUTOINCREMENT, hypertable INTEGER NOT NULL REFERENCES hypertables, kind TEXT NOT NULL,
    at REAL NOT NULL, operation TEXT, fingerprint BLOB);
CREATE UNIQUE INDEX IF NOT EXISTS commit_operations ON commits (operation) WHERE operation IS NOT NULL;
CREATE TABLE IF NOT EXISTS parts (id INTEGER PRIMARY KEY AUTOINCREMENT, hypertable INTEGER NOT NULL REFERENCES hypertables, path TEXT UNIQUE NOT NULL,
    partition TEXT NOT NULL, key_min INTEGER, key_max INTEGER, rows INTEGER NOT NULL, bytes INTEGER NOT NULL, level INTEGER NOT NULL, stats TEXT,
    key_bloom BLOB, created_by INTEGER NOT NULL REFERENCES commits, removed_by INTEGER REFERENCES commits, removed_at REAL, purged_at REAL);
CREATE INDEX IF NOT EXISTS live_parts ON parts (hypertable, partition, level) WHERE removed_by IS NULL;
CREATE INDEX IF NOT EXISTS dead_parts ON parts (removed_by) WHERE removed_by IS NOT NULL AND purged_at IS NULL;
CREATE TABLE IF NOT EXISTS offsets (hypertable INTEGER NOT NULL, topic TEXT NOT NULL, partition INTEGER NOT NULL, next INTEGER NOT NULL,
    PRIMARY KEY (hypertable, topic, partition));
CREATE TABLE IF NOT EXISTS cursors (worker TEXT NOT NULL, hypertable INTEGER NOT NULL, commit_id INTEGER NOT NULL, PRIMARY KEY (worker, hypertable));
CREATE TABLE IF NOT EXISTS generations (id INTEGER PRIMARY KEY AUTOINCREMENT);
CREATE TABLE IF NOT EXISTS leases (hypertable INTEGER NOT NULL, partition TEXT NOT NULL, owner TEXT NOT NULL, generation INTEGER NOT NULL,
    expires REAL NOT NULL, PRIMARY KEY (hypertable, partition));
CREATE TABLE IF NOT EXISTS pending_objects (path TEXT PRIMARY KEY, hypertable INTEGER NOT NULL, at REAL NOT NULL);
"""


class Catalog:
    def __init__(self, path: str = ":memory:", clock: Callable[[], float] = time.time):
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self._db.row_factory = sqlite3.Row
        self._db.execute("PRAGMA foreign_keys = ON")
        self._db.executescript(_TABLES)
        self._lock = threading.RLock()
        self.clock = clock

    @contextmanager
    def _transaction(self):
        with self._lock:
            self._db.execute("BEGIN IMMEDIATE")
            try:
                yield self._db
            except BaseException:
                self._db.execute("ROLLBACK")
                raise
            self._db.execute("COMMIT")

    def _all(self, sql: str, *args) -> list[sqlite3.Row]:
        with self._lock:
            return self._db.execute(sql, args).fetchall()

    # Tables

    def create_hypertable(self, name: str, columns: TableColumns, sort_key: Sequence[str], packing_key: str, partition_by: Sequence[str] = ("day",), time: str | None = None, placement: int | None = None) -> Hypertable:
        check_sort_key(columns, list(sort_key), packing_key, time)
        with self._transaction() as db:
            if db.execute("SELECT 1 FROM hypertables WHERE name = ?", (name,)).fetchone():
                raise CatalogError(f"hypertable {name!r} exists")
            db.execute("INSERT INTO hypertables (name, schema, partition_by, sort_key, packing_key, time, placement) VALUES (?, ?, ?, ?, ?, ?, ?)", (name, columns.json(), json.dumps(list(partition_by)), json.dumps(list(sort_key)), packing_key, time, placement))
        return self.hypertable(name)

    def _table(self, r: sqlite3.Row) -> Hypertable:
        return Hypertable(r["id"], r["name"], TableColumns.parse(r["schema"]), tuple(json.loads(r["partition_by"])), tuple(json.loads(r["sort_key"])), r["packing_key"], r["time"], r["placement"])

    def hypertable(self, name: str | int) -> Hypertable:
        found = self._all(f"SELECT * FROM hypertables WHERE {'id' if isinstance(name, int) else 'name'} = ?", name)
        if not found:
            raise NotFound(f"hypertable {name!r}")
        return self._table(found[0])

    def hypertables(self) -> list[Hypertable]:
        return [self._table(r) for r in self._all("SELECT * FROM hypertables ORDER BY id")]

    def set_placement(self, name: str | int, placement: int | None) -> None:
        ht = self.hypertable(name)
        with self._transaction() as db:
            db.execute("UPDATE hypertables SET placement = ? WHERE id = ?", (placement, ht.id))

    def create_logical_table(self, namespace: int, name: str, hypertable: str | int) -> None:
        ht = self.hypertable(hypertable)
        with self._transaction() as db:
            try:
                db.execute("INSERT INTO logical_tables (namespace, name, hypertable) VALUES (?, ?, ?)", (namespace, name, ht.id))
            except sqlite3.IntegrityError:
                raise CatalogError(f"namespace {namespace} has a table {name!r}") from None

    def logical_tables(self, namespace: int) -> list[tuple[str, Hypertable]]:
        rows = self._all("SELECT l.name AS logical, h.* FROM logical_tables l JOIN hypertables h ON h.id = l.hypertable WHERE namespace = ? ORDER BY 1", namespace)
        return [(r["logical"], self._table(r)) for r in rows]

    def logical_table(self, namespace: int, name: str) -> Hypertable:
        for found, ht in self.logical_tables(namespace):
            if found == name:
                return ht
        raise NotFound(f"table {name!r} in namespace {namespace}")

    # Commits

    def lookup(self, identity: OperationIdentity) -> int | None:
        """The commit of this operation; None if there is none."""
        found = self._all("SELECT id, fingerprint FROM commits WHERE operation = ?", identity.key)
        if not found:
            return None
        if found[0]["fingerprint"] != identity.fingerprint:
            raise OperationKeyCollision(identity.key)
        return found[0]["id"]

    def commit(
        self,
        hypertable: int,
        add: Iterable[Part] = (),
        remove: Iterable[int] = (),
        identity: OperationIdentity | None = None,
        offsets: Iterable[OffsetRange] = (),
        lease: Lease | None = None,
    ) -> CommitResult:
        """One transaction: new parts go live, old ones cease to be, offsets advance.

        Repeating an operation returns the first commit unchanged, before anything else is looked at (also
        the lease).  All of it is rolled back on a part that is not live, an offset race or a lost lease.
        """
        add, remove, offsets = list(add), sorted(remove), sorted(offsets)
        kind = "replace" if add and remove else "delete" if remove else "add"
        with self._transaction() as db:
            if identity is not None:
                done = db.execute("SELECT id, hypertable, fingerprint FROM commits WHERE operation = ?", (identity.key,)).fetchone()
                if done:
                    if done["fingerprint"] != identity.fingerprint or done["hypertable"] != hypertable:
                        raise OperationKeyCollision(identity.key)
                    return CommitResult(done["id"], False)
            if lease is not None:
                self._fence(db, lease, hypertable, remove, add)
            now = self.clock()
            cid = db.execute("INSERT INTO commits (hypertable, kind, at, operation, fingerprint) VALUES (?, ?, ?, ?, ?)", (hypertable, kind, now, identity and identity.key, identity and identity.fingerprint)).lastrowid
            for old in remove:
                if db.execute("UPDATE parts SET removed_by = ?, removed_at = ? WHERE id = ? AND hypertable = ? AND removed_by IS NULL", (cid, now, old, hypertable)).rowcount != 1:
                    raise Conflict(f"part {old} is not live")
            ids = []
            for p in add:
                ids.append(
                    db.execute(
                        "INSERT INTO parts (hypertable, path, partition, key_min, key_max, rows, bytes, level, stats, key_bloom, created_by) VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)",
                        (hypertable, p.path, p.partition, p.key_min, p.key_max, p.rows, p.bytes, p.level, json.dumps(p.stats) if p.stats is not None else None, p.key_bloom, cid),
                    ).lastrowid
                )
                db.execute("DELETE FROM pending_objects WHERE path = ?", (p.path,))
            for o in offsets:
                at = db.execute("SELECT next FROM offsets WHERE hypertable = ? AND topic = ? AND partition = ?", (hypertable, o.topic, o.partition)).fetchone()
                if at and at["next"] > o.first:
                    raise OffsetRace(f"{o.topic}/{o.partition}: next is {at['next']}, not {o.first}")
                db.execute("INSERT INTO offsets VALUES (?, ?, ?, ?) ON CONFLICT (hypertable, topic, partition) DO UPDATE SET next = excluded.next", (hypertable, o.topic, o.partition, o.last + 1))
        return CommitResult(cid, True, ids)

    def offsets(self, hypertable: int) -> dict[tuple[str, int], int]:
        return {(r["topic"], r["partition"]): r["next"] for r in self._all("SELECT * FROM offsets WHERE hypertable = ?", hypertable)}

    # Parts

    def _part(self, r: sqlite3.Row) -> Part:
        return Part(r["path"], r["partition"], r["key_min"], r["key_max"], r["rows"], r["bytes"], r["level"], json.loads(r["stats"]) if r["stats"] else None, r["key_bloom"], r["id"], r["created_by"])

    def live_parts(self, hypertable: int, key: int | None = None, ranges: Sequence[ColumnRange] = (), partition: str | None = None, as_of: int | None = None) -> list[Part]:
        """Parts that may hold rows of `key` within `ranges`; `as_of` a commit, those that were live then."""
        if as_of is None:
            sql, args = "removed_by IS NULL", []
        else:
            sql, args = "created_by <= ? AND (removed_by IS NULL OR removed_by > ?)", [as_of, as_of]
        if key is not None:
            sql += " AND (key_min IS NULL OR key_max IS NULL OR ? BETWEEN key_min AND key_max)"
            args.append(key)
        if partition is not None:
            sql += " AND partition = ?"
            args.append(partition)
        rows = self._all(f"SELECT * FROM parts WHERE hypertable = ? AND {sql} ORDER BY id", hypertable, *args)
        return [p for p in map(self._part, rows) if not part_excluded(p, key, ranges)]

    def part(self, id: int) -> Part:
        found = self._all("SELECT * FROM parts WHERE id = ?", id)
        if not found:
            raise NotFound(f"part {id}")
        return self._part(found[0])

    # Change feed and cursors

    def changes_since(self, hypertable: int, after: int = 0, limit: int = 1000) -> list[dict]:
        """Commits behind `after` in order: id, kind, added parts (live or not) and removed part ids."""
        out = []
        for c in self._all("SELECT * FROM commits WHERE hypertable = ? AND id > ? ORDER BY id LIMIT ?", hypertable, after, limit):
            added = [self._part(r) for r in self._all("SELECT * FROM parts WHERE created_by = ? ORDER BY id", c["id"])]
            removed = [r["id"] for r in self._all("SELECT id FROM parts WHERE removed_by = ? ORDER BY id", c["id"])]
            out.append({"commit": c["id"], "kind": c["kind"], "at": c["at"], "added": added, "removed": removed})
        return out

    def feed_head(self, hypertable: int) -> int:
        return self._all("SELECT COALESCE(MAX(id), 0) AS head FROM commits WHERE hypertable = ?", hypertable)[0]["head"]

    def cursor(self, worker: str, hypertable: int) -> int:
        found = self._all("SELECT commit_id FROM cursors WHERE worker = ? AND hypertable = ?", worker, hypertable)
        return found[0]["commit_id"] if found else 0

    def set_cursor(self, worker: str, hypertable: int, commit: int) -> None:
        """Advance a cursor; it never retreats."""
        with self._transaction() as db:
            db.execute("INSERT INTO cursors VALUES (?, ?, ?) ON CONFLICT (worker, hypertable) DO UPDATE SET commit_id = excluded.commit_id WHERE excluded.commit_id > commit_id", (worker, hypertable, commit))

    # Leases

    def acquire_lease(self, hypertable: int, partition: str, owner: str, ttl: float = 60.0) -> Lease | None:
        """None while someone else's lease runs.  The same owner keeps its generation; others get a new one."""
        with self._transaction() as db:
            now = self.clock()
            held = db.execute("SELECT * FROM leases WHERE hypertable = ? AND partition = ?", (hypertable, partition)).fetchone()
            if held and held["expires"] > now:
                if held["owner"] != owner:
                    return None
                generation = held["generation"]
            else:
                generation = db.execute("INSERT INTO generations DEFAULT VALUES").lastrowid
            db.execute("INSERT OR REPLACE INTO leases VALUES (?, ?, ?, ?, ?)", (hypertable, partition, owner, generation, now + ttl))
            return Lease(hypertable, partition, owner, generation)

    def _held(self, db, lease: Lease) -> bool:
        return bool(db.execute("SELECT 1 FROM leases WHERE hypertable = ? AND partition = ? AND owner = ? AND generation = ? AND expires > ?", (lease.hypertable, lease.partition, lease.owner, lease.generation, self.clock())).fetchone())

    def renew_lease(self, lease: Lease, ttl: float = 60.0) -> None:
        with self._transaction() as db:
            if not self._held(db, lease):
                raise LeaseLost(lease.partition)
            db.execute("UPDATE leases SET expires = ? WHERE hypertable = ? AND partition = ?", (self.clock() + ttl, lease.hypertable, lease.partition))

    def release_lease(self, lease: Lease) -> None:
        with self._transaction() as db:
            db.execute("DELETE FROM leases WHERE hypertable = ? AND partition = ? AND owner = ? AND generation = ?", (lease.hypertable, lease.partition, lease.owner, lease.generation))

    def _fence(self, db, lease: Lease, hypertable: int, remove: Sequence[int], add: Sequence[Part]) -> None:
        if lease.hypertable != hypertable or not self._held(db, lease):
            raise LeaseLost(lease.partition)
        marks = ",".join("?" * len(remove))
        foreign = db.execute(f"SELECT id FROM parts WHERE id IN ({marks}) AND partition <> ?", (*remove, lease.partition)).fetchall() if remove else []
        if foreign or any(p.partition != lease.partition for p in add):
            raise CatalogError("a leased commit stays within its partition")

    # What there is to compact

    def runs(self, hypertable: int) -> list[dict]:
        """Live parts by partition and level: parts, distinct creating commits (runs), bytes."""
        rows = self._all("SELECT partition, level, COUNT(*) AS parts, COUNT(DISTINCT created_by) AS runs, SUM(bytes) AS bytes FROM parts WHERE hypertable = ? AND removed_by IS NULL GROUP BY 1, 2 ORDER BY 1, 2", hypertable)
        return [dict(r) for r in rows]

    def _without_peers(self, hypertable: int, partitions: list[str], owner: str | None) -> list[str]:
        held = {r["partition"] for r in self._all("SELECT partition FROM leases WHERE hypertable = ? AND expires > ? AND owner <> ?", hypertable, self.clock(), owner or "")}
        return [p for p in partitions if p not in held]

    def compaction_candidates(self, hypertable: int, l0_fanout: int, fanout: int, owner: str | None = None, after: str = "", limit: int = 64) -> list[str]:
        """Partitions with a level of enough runs, not leased by a peer; a window behind `after`, then around."""
        found = sorted({r["partition"] for r in self.runs(hypertable) if r["runs"] >= (l0_fanout if r["level"] == 0 else fanout)})
        found = self._without_peers(hypertable, found, owner)
        return ([p for p in found if p > after] + [p for p in found if p <= after])[:limit]

    def finalize_candidates(self, hypertable: int, quiet: float, owner: str | None = None, after: str = "", limit: int = 64) -> list[str]:
        """Partitions of at least two runs whose newest level-0 commit is `quiet` seconds old."""
        rows = self._all(
            "SELECT p.partition FROM parts p JOIN commits c ON c.id = p.created_by WHERE p.hypertable = ? AND p.removed_by IS NULL GROUP BY 1 HAVING COUNT(DISTINCT p.created_by) >= 2 "
            "AND COALESCE(MAX(CASE WHEN p.level = 0 THEN c.at END), 0) <= ? ORDER BY 1",
            hypertable,
            self.clock() - quiet,
        )
        found = self._without_peers(hypertable, [r["partition"] for r in rows], owner)
        return ([p for p in found if p > after] + [p for p in found if p <= after])[:limit]

    def max_l0_runs(self, hypertable: int) -> int:
        """The most live level-0 parts of a partition: what backpressure looks at."""
        return max((r["parts"] for r in self.runs(hypertable) if r["level"] == 0), default=0)

    # Upload intents and garbage

    def register_pending(self, hypertable: int, paths: Iterable[str]) -> None:
        with self._transaction() as db:
            db.executemany("INSERT OR REPLACE INTO pending_objects VALUES (?, ?, ?)", [(p, hypertable, self.clock()) for p in paths])

    def clear_pending(self, paths: Iterable[str]) -> None:
        with self._transaction() as db:
            db.executemany("DELETE FROM pending_objects WHERE path = ?", [(p,) for p in paths])

    def orphans(self, older: float) -> list[str]:
        return [r["path"] for r in self._all("SELECT path FROM pending_objects WHERE at <= ? ORDER BY at", self.clock() - older)]

    def reapable(self, grace: float) -> list[Part]:
        """Removed parts past the grace period that every worker's cursor has passed."""
        rows = self._all(
            "SELECT p.* FROM parts p WHERE removed_by IS NOT NULL AND purged_at IS NULL AND removed_at <= ? "
            "AND NOT EXISTS (SELECT 1 FROM cursors c WHERE c.hypertable = p.hypertable AND c.commit_id < p.removed_by) ORDER BY p.id",
            self.clock() - grace,
        )
        return [self._part(r) for r in rows]

    def mark_purged(self, id: int) -> None:
        with self._transaction() as db:
            db.execute("UPDATE parts SET purged_at = ? WHERE id = ?", (self.clock(), id))

    def known_paths(self, hypertable: int) -> set[str]:
        found = self._all("SELECT path FROM parts WHERE hypertable = ? AND purged_at IS NULL UNION SELECT path FROM pending_objects WHERE hypertable = ?", hypertable, hypertable)
        return {r["path"] for r in found}

    def gauges(self, hypertable: int) -> dict:
        """Live parts, rows and bytes, compaction and deletion backlog, feed lag of each worker, running leases."""
        live = self._all("SELECT COUNT(*) AS parts, COALESCE(SUM(rows), 0) AS rows, COALESCE(SUM(bytes), 0) AS bytes FROM parts WHERE hypertable = ? AND removed_by IS NULL", hypertable)[0]
        dead = self._all("SELECT COUNT(*) AS n FROM parts WHERE hypertable = ? AND removed_by IS NOT NULL AND purged_at IS NULL", hypertable)[0]["n"]
        head = self.feed_head(hypertable)
        lag = {r["worker"]: head - r["commit_id"] for r in self._all("SELECT * FROM cursors WHERE hypertable = ?", hypertable)}
        leases = self._all("SELECT COUNT(*) AS n FROM leases WHERE hypertable = ? AND expires > ?", hypertable, self.clock())[0]["n"]
        unfinal = self._all("SELECT COUNT(*) AS n FROM (SELECT 1 FROM parts WHERE hypertable = ? AND removed_by IS NULL GROUP BY partition HAVING COUNT(DISTINCT created_by) > 1)", hypertable)[0]["n"]
        return {**dict(live), "unpurged": dead, "lag": lag, "leases": leases, "unfinalized": unfinal}

    # Answers from metadata alone

    def metadata_aggregate(self, hypertable: int, column: str, key: int | None = None) -> tuple[int, int | None, int | None] | None:
        """(rows, min, max) without reading a file, or None where the parts cannot tell.

        Scoped to a key it is exact only if every part that may hold the key holds nothing else.
        """
        parts = self.live_parts(hypertable, key)
        if key is not None and any(p.key_min != key or p.key_max != key for p in parts):
            return None
        stats = [(p.stats or {}).get("columns", {}).get(column) for p in parts if p.rows]
        if any(s is None for s in stats):
            return None
        low, high = [s["min"] for s in stats if s["min"] is not None], [s["max"] for s in stats if s["max"] is not None]
        return sum(p.rows for p in parts), min(low, default=None), max(high, default=None)
