"""The table layer: schemas, commits, pruning, isolation, ingest, compaction, deletion, garbage."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions.expressions import column_refs, fill, validate, with_aliases
from spindrift.operators import keyfilter, writer
from spindrift.operators.catalog import Catalog, CatalogError, Conflict, LeaseLost, OffsetRace, OperationKeyCollision, Part
from spindrift.operators.identity import IdentityError, OffsetRange, OperationIdentity, canonical, compaction_identity, ingest_identity
from spindrift.operators.maintenance import Compactor, Policy, Retention, collect_garbage, delete_key, misordered
from spindrift.operators.pruning import ColumnRange, bounds
from spindrift.operators.writer import write
from spindrift.plans import session
from spindrift.sources import files
from spindrift.sources.schema import SchemaError, TableColumns, UnsupportedType, check_sort_key
from spindrift.streaming.ingest import Ingest, IngestConfig, assignment, flush_decision, in_bounds, json_lines

EVENTS = {"fields": [{"name": "tenant_id", "type": "int64", "nullable": False}, {"name": "ts", "type": "timestamp_ms"}, {"name": "payload", "type": "utf8"}]}
DAY = 86_400_000


class Clock:
    now = 1_780_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture
def lake(spark, tmp_path):
    clock = Clock()
    catalog = Catalog(clock=clock)
    ht = catalog.create_hypertable("events", TableColumns.parse(EVENTS), ["tenant_id", "ts"], "tenant_id", time="ts")
    for ns in (1, 2, 42):
        catalog.create_logical_table(ns, "events", "events")
    return catalog, ht, f"file://{tmp_path}/lake", clock


def put(spark, lake, rows, level=0, columns="tenant_id long, ts long, payload string"):
    catalog, ht, root, _ = lake
    df = fill(spark.createDataFrame(rows, columns), ht.columns).withColumn("day", F.lit("2026-01-01"))
    parts = write(spark, catalog, ht, root, df, level)
    return catalog.commit(ht.id, parts)


def seen(spark, catalog, ns, sql="SELECT payload FROM events ORDER BY ts"):
    return [tuple(r) for r in session.Namespace(spark, catalog, ns).sql(sql).collect()]


def test_schema_rules():
    with pytest.raises(UnsupportedType):
        TableColumns.parse({"fields": [{"name": "d", "type": "decimal"}]})
    with pytest.raises(SchemaError):
        TableColumns.parse({"fields": [{"name": "d", "type": "int64", "default": "1", "alias": "2"}]})
    with pytest.raises(SchemaError):
        TableColumns.parse({"fields": [{"name": "d", "type": "int64", "alias": "2", "bloom_filter": True}]})
    columns = TableColumns.parse(EVENTS)
    assert TableColumns.parse(columns.json()) == columns
    assert columns.query["ts"].metadata and not columns.query["tenant_id"].metadata
    for bad in ([], ["ts", "tenant_id"], ["tenant_id", "nope"], ["tenant_id"]):
        with pytest.raises(SchemaError):
            check_sort_key(columns, bad, "tenant_id", "ts")


def test_column_kinds(spark):
    rich = TableColumns.parse({"fields": [{"name": "tenant_id", "type": "int64"}, {"name": "ts", "type": "timestamp_ms"}, {"name": "amount", "type": "float64", "default": "0.0"}, {"name": "doubled", "type": "float64", "materialized": "amount * 2.0"}, {"name": "half", "type": "float64", "alias": "amount / 2.0"}]})
    validate(spark, rich)
    rows = with_aliases(fill(spark.createDataFrame([(1, 1, 8.0), (1, 2, None)], "tenant_id long, ts long, amount double"), rich), rich)
    assert rows.columns == ["tenant_id", "ts", "amount", "doubled", "half"]
    assert [tuple(r)[2:] for r in rows.orderBy("ts").collect()] == [(8.0, 16.0, 4.0), (0.0, 0.0, 0.0)]
    assert [r.ts for r in rows.where("half > 1.0").collect()] == [1]
    assert column_refs(spark, rich.physical, "amount + ts") == ["amount", "ts"]
    for bad in ("rand()", "now()", "uuid()", "half + 1", "doubled + 1", "nope", "current_timestamp"):
        with pytest.raises(SchemaError):
            validate(spark, TableColumns.parse({"fields": [*json.loads(rich.json())["fields"], {"name": "x", "type": "float64", "materialized": bad}]}))


def test_identities():
    a, b = OffsetRange("t", 0, 0, 4), OffsetRange("t", 1, 3, 3)
    assert ingest_identity(1, [a, b]) == ingest_identity(1, [b, a]) != ingest_identity(2, [a, b])
    for bad in ([], [OffsetRange("t", 0, 4, 0)], [a, OffsetRange("t", 0, 4, 9)]):
        with pytest.raises(IdentityError):
            ingest_identity(1, bad)
    assert compaction_identity(1, [3, 1], 1) == compaction_identity(1, [1, 3], 1)
    with pytest.raises(IdentityError):
        compaction_identity(1, [1, 1], 1)
    values = [None, True, False, 0, 1, "1", b"1", [], [[]], {}, ["a", "b"], ["ab"], {"a": 1}, [["a", 1]]]
    assert len({canonical(v) for v in values}) == len(values)


@pytest.mark.parametrize("n", [513, 3000, 20_000])
def test_bloom_never_loses_a_key(n):
    rng = random.Random(n)
    for keys in (range(-5, n - 5), rng.sample(range(-(1 << 61), 1 << 61), n)):
        f = keyfilter.bloom(keys)
        assert all(keyfilter.bloom_may_hold(f, k) for k in keys) and len(f) < 1.3 * n
    held = set(keys)
    wrong = sum(keyfilter.bloom_may_hold(f, k) for k in (rng.randrange(1 << 62) for _ in range(4000)) if k not in held)
    assert wrong < 90  # 1 % is aimed at


def test_undecidable_keeps():
    assert keyfilter.key_set([5]) is None and keyfilter.key_set(range(keyfilter.SET_LIMIT + 1)) is None and keyfilter.key_set([3, -1, 3]) == [-1, 3]
    assert keyfilter.bloom(range(keyfilter.SET_LIMIT)) is None and keyfilter.bloom(range(keyfilter.BLOOM_LIMIT + 1)) is None
    for broken in (None, b"", b"\x07", b"\x00abc", b"\xffabc"):
        assert keyfilter.bloom_may_hold(broken, 99)


def test_pruning_contract(lake):
    catalog, ht, _, _ = lake

    def part(path, keys, **stats):
        return Part(path, "day=x", min(keys), max(keys), 1, 1, stats={"keys": keyfilter.key_set(keys), **stats}, key_bloom=keyfilter.bloom(keys))

    catalog.commit(ht.id, [part("odd", [11, 13, 17, 90]), part("even", [10, 16, 90]), part("many", range(0, 5000, 5)), Part("unknown", "day=x", None, None, 1, 1)])
    names = lambda *a, **k: {p.path for p in catalog.live_parts(ht.id, *a, **k)}
    assert names(13) - {"many"} == {"odd", "unknown"} and names(90) == {"odd", "even", "many", "unknown"} and names(-4) == {"unknown"}
    assert sum("many" in names(k) for k in range(1, 401, 5)) < 10
    catalog.commit(ht.id, [part("spring", [90_000, 90_001], columns={"ts": {"min": 40, "max": 60}}), part("autumn", [90_000, 90_001], columns={"ts": {"min": 300, "max": 330}}), part("undated", [90_000, 90_001])])
    assert names(90_000, [ColumnRange("ts", low=61, high=299)]) == {"undated", "unknown"}
    assert names(90_000, [ColumnRange("ts", high=40)]) == {"spring", "undated", "unknown"}
    assert names(90_000, [ColumnRange("elsewhere", 0, 0)]) == {"spring", "autumn", "undated", "unknown"}
    catalog.commit(ht.id, [part("spans", [-50, -10], row_groups=[[-50, -45], [-12, -10]]), part("malformed", [-50, -10], row_groups=[[0]])])
    assert "spans" in names(-50) and "spans" not in names(-30)


def test_parts_can_be_read_back(spark, lake):
    """Level-0 parts with every kind of column, as many rows as make several pages."""
    catalog, ht, root, _ = lake
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    rows = fill(e.select(F.col("user_id").alias("tenant_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat_ws(" ", "event_type", "event_id").alias("payload")), ht.columns).withColumn("day", F.lit("2026-01-01"))
    catalog.commit(ht.id, write(spark, catalog, ht, root, rows))
    want = rows.selectExpr("count(*)", "bit_xor(xxhash64(tenant_id, ts, payload))").first()
    assert tuple(session.Namespace(spark, catalog, None).sql("SELECT count(*), bit_xor(xxhash64(tenant_id, ts, payload)) FROM events").first()) == tuple(want)


def test_bounds(spark):
    got = {r.column: (r.low, r.high) for r in bounds(spark, "ts >= 5 AND 10 > ts AND `k` = 3 AND (x < 1 OR x > 2) AND v < 1.5 AND payload = 'a'", ["ts", "k", "x", "v"])}
    assert got == {"ts": (5, 9), "k": (3, 3)}


def test_isolation_and_gate(spark, lake):
    catalog, ht, root, _ = lake
    put(spark, lake, [(2, 7, "pear"), (1, 3, "fig"), (1, 8, "plum"), (1, 9, "lime")])
    put(spark, lake, [(2, 1, "kiwi")])
    assert seen(spark, catalog, 1) == [("fig",), ("plum",), ("lime",)] and seen(spark, catalog, 2) == [("kiwi",), ("pear",)] and seen(spark, catalog, 42) == []
    assert seen(spark, catalog, 1, "SELECT payload FROM events WHERE ts < 9 ORDER BY 1") == [("fig",), ("plum",)]
    assert seen(spark, catalog, None, "SELECT tenant_id, count(*) FROM events GROUP BY 1 ORDER BY 1") == [(1, 3), (2, 2)]
    assert seen(spark, catalog, 1, "WITH events AS (SELECT 1 AS ts) SELECT ts FROM events") == [(1,)]
    assert seen(spark, catalog, 1, "SELECT 'information_schema.tables' AS x, to_timestamp_seconds(0) = to_timestamp_millis(0) AS y") == [("information_schema.tables", True)]
    assert seen(spark, catalog, 1, "SELECT payload FROM events WHERE ts IN (SELECT max(ts) FROM events)") == [("lime",)]
    many = ", ".join(f"{k} AS c{k}" for k in range(40))
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW outside AS SELECT 1 AS x")
    path = catalog.live_parts(ht.id)[0].path
    spark.range(1).createOrReplaceGlobalTempView("other")
    ns = session.Namespace(spark, catalog, 1)
    for bad in (
        f"SELECT * FROM parquet.`{path}`", "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT reflect('java.lang.Math', 'abs', -1)", "DROP TABLE events", "INSERT INTO events VALUES (1, 2, 'x')",
        "CREATE TEMPORARY VIEW x AS SELECT 1", "SET a=b", "SELECT * FROM global_temp.other", "SELECT * FROM nope", "SELEC 1", "CACHE TABLE events", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2",
        "SELECT * FROM (SELECT reflect('java.lang.Math', 'abs', -1) AS x)", f"SELECT {many}, reflect('java.lang.System', 'getProperty', 'user.home')",
        f"WITH c AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{root}/out' USING parquet SELECT * FROM c", "WITH c AS (SELECT 1 AS a) INSERT INTO events SELECT * FROM c", "FROM events INSERT INTO x SELECT ts INSERT INTO y SELECT ts",
        "SELECT * FROM default.events", "SELECT * FROM outside", "SELECT (SELECT max(x) FROM outside)", "SELECT 1 FROM events WHERE EXISTS (SELECT 1 FROM outside)", "SELECT * FROM (WITH z AS (SELECT 1) SELECT * FROM z) JOIN z", "SELECT * FROM IDENTIFIER('events')",
        "SELECT ts FROM events ORDER BY reflect('java.lang.Math', 'abs', -1)", "SELECT * FROM events LATERAL VIEW reflect('a', 'b') t AS x", "SELECT transform(array(1), x -> java_method('java.lang.Math', 'abs', x))", "WITH c AS (SELECT java_method('java.lang.Math', 'abs', -1) AS x) SELECT * FROM c",
    ):
        with pytest.raises(session.QueryError):
            ns.sql(bad).collect()
    assert seen(spark, catalog, 7, "SELECT count(*) FROM information_schema.tables") == [(0,)]
    assert seen(spark, catalog, 1, "SELECT column_name, data_type FROM information_schema.columns ORDER BY ordinal_position") == [("tenant_id", "int64"), ("ts", "timestamp_ms"), ("payload", "utf8")]


def test_statement_bounds_prune(spark, lake):
    catalog, ht, _, _ = lake
    for k in range(3):
        put(spark, lake, [(1, 100 * k + j, f"p{k}{j}") for j in range(5)])
    ns = session.Namespace(spark, catalog, 1)
    files_of = lambda sql: len(ns.sql(sql).inputFiles())
    assert files_of("SELECT payload FROM events") == 3
    assert files_of("SELECT payload FROM events WHERE ts >= 100 AND ts < 150") == 1
    assert files_of("SELECT payload FROM events e WHERE e.ts BETWEEN 90 AND 210") == 2
    assert files_of("WITH late AS (SELECT * FROM events WHERE ts > 150) SELECT count(*) FROM late") == 1
    assert files_of("SELECT payload FROM events WHERE ts > 150 OR payload = 'p00'") == 3
    assert files_of("SELECT * FROM events a JOIN events b ON a.ts = b.ts WHERE a.ts > 150") == 3
    assert [r[0] for r in ns.sql("SELECT payload FROM events WHERE ts = 203").collect()] == ["p23"] and files_of("SELECT payload FROM events") == 3


def test_files_of_one_name_are_all_ingested(spark, lake, tmp_path):
    catalog, _, root, _ = lake
    ingest = Ingest(spark, catalog, root, "events", lambda: NOW)
    for k, folder in enumerate(("a", "b")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "part.json").write_text("\n".join(json.dumps({"tenant_id": k, "ts": NOW - j, "payload": f"{folder}{j}"}) for j in range(5)))
        for _ in range(2):
            ingest.start(json_lines(spark, str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert seen(spark, catalog, None, "SELECT tenant_id, count(*) FROM events GROUP BY 1 ORDER BY 1") == [(0, 5), (1, 5)]


def test_full_level_zero_holds_ingest_back(spark, lake):
    catalog, ht, root, _ = lake
    compactor = Compactor(spark, catalog, root, policy=Policy(2, 2, 10))
    ingest = Ingest(spark, catalog, root, "events", lambda: NOW, IngestConfig(slowdown=2, stop=3), relieve=lambda: compactor.compact_once("events"))
    for k in range(5):
        ingest.batch(spark.createDataFrame([("t", 0, k, json.dumps({"tenant_id": 1, "ts": NOW, "payload": str(k)}))], "topic string, partition int, offset long, value string"))
        assert sum(p.level == 0 for p in catalog.live_parts(ht.id)) <= 3
    assert ingest.deferrals >= 1 and len(seen(spark, catalog, 1)) == 5


def test_query_formats(spark, lake):
    catalog = lake[0]
    put(spark, lake, [(1, 100, "oak"), (1, 200, None)])
    long = session.Limits(60, 60)
    out = session.query(spark, catalog, 1, "SELECT ts, ts + 1 AS next, payload FROM events ORDER BY ts", limits=long)
    assert out["columns"] == {"ts": [100, 200], "next": [101, 201], "payload": ["oak", None]}
    assert [c["type"] for c in out["schema"]] == ["timestamp_ms", "int64", "utf8"]
    assert session.query(spark, catalog, 1, "SELECT payload FROM events WHERE ts < 150", "rows", limits=long, where="ts < 150")["rows"] == [{"payload": "oak"}]
    import pyarrow as pa

    raw = session.query(spark, catalog, 1, "SELECT count(*) AS n FROM events", accept="application/vnd.apache.arrow.stream", limits=long)["arrow"]
    assert pa.ipc.open_stream(raw).read_all()["n"].to_pylist() == [2]
    with pytest.raises(session.Timeout):
        session.query(spark, catalog, 1, "SELECT sum(a.id * b.id) FROM range(300000) a CROSS JOIN range(300000) b", limits=session.Limits(1.5, 60))
    with pytest.raises(session.Unavailable):
        session.query(spark, catalog, 1, "SELECT 1", limits=session.Limits(60, 0))
    with pytest.raises(session.QueryError):
        session.query(spark, catalog, 1, "SELECT 1", "xml")
    with pytest.raises(ValueError):
        Retention(900).check(900)


def test_commit_protocol(lake):
    catalog, ht, _, clock = lake
    mine = OperationIdentity.of("test", 1)
    first = catalog.commit(ht.id, [Part("a", "day=x", 1, 1, 1, 1), Part("b", "day=x", 1, 1, 1, 1)], identity=mine)
    assert first.applied and catalog.commit(ht.id, [Part("zz", "day=x", 1, 1, 1, 1)], identity=mine) == type(first)(first.commit, False)
    with pytest.raises(OperationKeyCollision):
        catalog.commit(ht.id, identity=type("I", (), {"key": mine.key, "fingerprint": b"other"})())
    a, b = first.parts
    catalog.commit(ht.id, [Part("c", "day=x", 1, 1, 2, 1, 1)], [a, b])
    with pytest.raises(Conflict):
        catalog.commit(ht.id, [Part("d", "day=x", 1, 1, 2, 1, 1)], [a])
    assert [p.path for p in catalog.live_parts(ht.id)] == ["c"]
    assert [p.path for p in catalog.live_parts(ht.id, as_of=first.commit)] == ["a", "b"]
    catalog.commit(ht.id, [Part("e", "day=x", 1, 1, 1, 1)], offsets=[OffsetRange("t", 0, 0, 9)])
    catalog.commit(ht.id, offsets=[OffsetRange("t", 0, 12, 20)])  # gaps are legal
    with pytest.raises(OffsetRace):
        catalog.commit(ht.id, [Part("f", "day=x", 1, 1, 1, 1)], offsets=[OffsetRange("t", 0, 20, 25)])
    assert "f" not in {p.path for p in catalog.live_parts(ht.id)} and catalog.offsets(ht.id) == {("t", 0): 21}
    feed = catalog.changes_since(ht.id)
    assert [c["kind"] for c in feed] == ["add", "replace", "add", "add"] and feed[1]["removed"] == [a, b]
    assert [c["commit"] for c in catalog.changes_since(ht.id, feed[1]["commit"])] == [feed[2]["commit"], feed[3]["commit"]]
    catalog.set_cursor("w", ht.id, 5)
    catalog.set_cursor("w", ht.id, 3)
    assert catalog.cursor("w", ht.id) == 5
    assert catalog.metadata_aggregate(ht.id, "ts") is None
    with pytest.raises(CatalogError):
        catalog.create_logical_table(1, "events", "events")


def test_leases(lake):
    catalog, ht, _, clock = lake
    one = catalog.acquire_lease(ht.id, "day=x", "a", 60)
    assert catalog.acquire_lease(ht.id, "day=x", "b", 60) is None and catalog.acquire_lease(ht.id, "day=x", "a", 60) == one
    clock.now += 61
    two = catalog.acquire_lease(ht.id, "day=x", "b", 60)
    assert two.generation > one.generation
    with pytest.raises(LeaseLost):
        catalog.renew_lease(one)
    with pytest.raises(LeaseLost):
        catalog.commit(ht.id, [Part("a", "day=x", 1, 1, 1, 1)], lease=one)
    with pytest.raises(CatalogError):
        catalog.commit(ht.id, [Part("a", "day=y", 1, 1, 1, 1)], lease=two)
    catalog.release_lease(one)
    assert catalog.acquire_lease(ht.id, "day=x", "a") is None


def test_ladder_finalize_delete_and_garbage(spark, lake):
    catalog, ht, root, clock = lake
    compactor = Compactor(spark, catalog, root, policy=Policy(2, 2, 10))
    for name in "ab":
        put(spark, lake, [(1, ord(name), name), (3, ord(name), name.upper())])
    assert compactor.compact_once("events") == 1 and {p.level for p in catalog.live_parts(ht.id)} == {1}
    for name in "cd":
        put(spark, lake, [(1, ord(name), name)])
    assert compactor.compact_once("events") == 1 and compactor.compact_once("events") == 1 and compactor.compact_once("events") == 0
    live = catalog.live_parts(ht.id)
    assert {p.level for p in live} == {2} and misordered(spark, ht, live) == []
    everything = "SELECT tenant_id, ts, payload FROM events ORDER BY 1, 2"
    want = [(1, 97, "a"), (1, 98, "b"), (1, 99, "c"), (1, 100, "d"), (3, 97, "A"), (3, 98, "B")]
    assert seen(spark, catalog, None, everything) == want
    put(spark, lake, [(3, 500, "late")])
    assert compactor.finalize_once("events") == 0
    clock.now += 20
    assert compactor.finalize_once("events") == 1 and {p.level for p in catalog.live_parts(ht.id)} == {3}
    put(spark, lake, [(3, 600, "own")])
    assert delete_key(spark, catalog, root, "events", 3) == 2 and delete_key(spark, catalog, root, "events", 3) == 0
    assert seen(spark, catalog, None, everything) == [r for r in want if r[0] != 3]
    assert catalog.metadata_aggregate(ht.id, "ts", key=1) == (4, 97, 100)
    assert collect_garbage(spark, catalog, root)["reaped"] == 0
    clock.now += 1000
    dead = collect_garbage(spark, catalog, root)["reaped"]
    assert dead > 0 and catalog.gauges(ht.id)["unpurged"] > 0  # what went behind the compactor's cursor stays
    compactor.compact_once("events")
    dead += collect_garbage(spark, catalog, root)["reaped"]
    assert dead >= 8 and catalog.gauges(ht.id)["unpurged"] == 0
    spark.range(1).write.parquet(f"{root}/ht/{ht.id}/L0/lost")
    clock.now += 10_000_000_000
    assert collect_garbage(spark, catalog, root, reconcile=True)["unknown"] >= 1
    assert set(files.listing(spark, f"{root}/ht/{ht.id}")) == {p.path for p in catalog.live_parts(ht.id)}
    assert seen(spark, catalog, 1) == [("a",), ("b",), ("c",), ("d",)]


def test_schema_evolution_and_backfill(spark, lake):
    catalog, ht, root, _ = lake
    put(spark, lake, [(1, 5, "old")])
    grown = TableColumns.parse({"fields": [*EVENTS["fields"], {"name": "n", "type": "int64", "default": "7"}, {"name": "twice", "type": "int64", "materialized": "ts * 2"}]})
    catalog._db.execute("UPDATE hypertables SET schema = ? WHERE id = ?", (grown.json(), ht.id))
    assert seen(spark, catalog, 1, "SELECT n, twice FROM events") == [(None, None)]
    put(spark, (catalog, catalog.hypertable("events"), *lake[2:]), [(1, 6, "new")])
    assert Compactor(spark, catalog, root, policy=Policy(2, 2)).compact_once("events") == 1
    assert seen(spark, catalog, 1, "SELECT payload, n, twice FROM events ORDER BY ts") == [("old", 7, 10), ("new", 7, 12)]


@pytest.mark.parametrize("placement", [None, 0])
def test_sorts_are_bounded(spark, lake, placement, monkeypatch):
    """No task sorts more than a given memory (twice it where a key crosses the cut), however large the table is."""
    monkeypatch.setattr(writer, "SORT_BYTES", 60_000, raising=False)
    catalog, ht, root, _ = lake
    catalog.set_placement("events", placement)
    ht = catalog.hypertable("events")
    rows = [(k, t, f"p{k}-{t}", day) for k in range(1, 41) for t in range(50) for day in ("2026-01-01", "2026-01-02")]
    rows += [(50, 7, f"tied{n}", "2026-01-01") for n in range(3000)] + [(60, t, "x" * 3000, "2026-01-02") for t in range(200)]
    df = spark.createDataFrame(rows, "tenant_id long, ts long, payload string, day string")
    for half in (0, 1):
        catalog.commit(ht.id, write(spark, catalog, ht, root, df.where(F.pmod(F.xxhash64("payload", "ts"), F.lit(2)) == half)))
    assert Compactor(spark, catalog, root, policy=Policy(2, 2)).compact_once("events") == 2
    parts = catalog.live_parts(ht.id)
    assert sum(p.rows for p in parts) == len(rows) and misordered(spark, ht, parts) == []
    if placement is None:
        assert max(p.rows for p in parts) < 1200
        assert max(p.rows for p in parts if p.key_max == 60) <= 40  # wide rows weigh more
        assert all(p.key_min == p.key_max for p in parts if p.key_max >= 50)
    else:
        assert sorted((p.partition, p.key_min, p.key_max) for p in parts) == sorted((f"day={d}", k, k) for k, d in {(r[0], r[3]) for r in rows})
    placed, tasks, plan = writer.placed(df, ht, 64.0)
    held = placed.groupBy("__task").agg(F.countDistinct("day", "__chunk").alias("files"), F.countDistinct("tenant_id").alias("keys"), F.sum(writer.sort_width(df)).alias("bytes")).collect()
    plan.unpersist()
    assert all(0 <= r["__task"] < tasks for r in held) and (placement == 0 or all(r["files"] == 1 for r in held))
    assert max(r["bytes"] for r in held if placement is None or r["keys"] > 1) <= 2 * writer.SORT_BYTES
    found = seen(spark, catalog, None, "SELECT tenant_id, ts, payload FROM events")
    assert sorted(found) == sorted(r[:3] for r in rows)


def test_large_key_without_time(spark, tmp_path, monkeypatch):
    """Without a time column a large key is tiled by a hash of its rows; without times, its rows share a file."""
    monkeypatch.setattr(writer, "SORT_BYTES", 60_000, raising=False)
    rows = [(k, n, f"p{n}", "2026-01-01") for k, many in ((1, 10), (2, 3000), (3, 10)) for n in range(many)]
    for time, columns in ((None, "tenant_id long, ts long, payload string, day string"), ("ts", "tenant_id long, ts long, payload string, day string")):
        catalog = Catalog()
        ht = catalog.create_hypertable("events", TableColumns.parse(EVENTS), ["tenant_id", "ts"], "tenant_id", time=time)
        df = spark.createDataFrame([r if time is None else (r[0], None, *r[2:]) for r in rows], columns)
        parts = write(spark, catalog, ht, f"file://{tmp_path}/{time}", df)
        assert sum(p.rows for p in parts) == len(rows) and misordered(spark, ht, parts) == []
        assert (max(p.rows for p in parts) < 1200) == (time is None)


def test_deletion_sorts_little(spark, lake, monkeypatch):
    """A key's deletion rewrites the parts that have it, each of what one task sorts, and leaves the others."""
    monkeypatch.setattr(writer, "SORT_BYTES", 60_000, raising=False)
    catalog, ht, root, _ = lake
    rows = [(k, t, f"p{k}-{t}") for k in range(1, 61) for t in range(100)]
    for half in (0, 1):
        put(spark, lake, [r for r in rows if r[1] % 2 == half])
    before = {p.path for p in catalog.live_parts(ht.id)}
    touched = delete_key(spark, catalog, root, "events", 7)
    parts = catalog.live_parts(ht.id)
    made = [p for p in parts if p.path not in before]
    assert 0 < touched <= 4 and len(before - {p.path for p in parts}) == touched
    assert made and max(p.rows for p in made) < 1200 and misordered(spark, ht, made) == []
    assert sorted(seen(spark, catalog, None, "SELECT tenant_id, ts, payload FROM events")) == [r for r in rows if r[0] != 7]


@pytest.mark.parametrize("placement", [None, 0, 4000])
def test_placement(spark, lake, placement):
    catalog, ht, root, _ = lake
    catalog.set_placement("events", placement)
    ht = catalog.hypertable("events")
    rows = [(k, t, f"p{k}-{t}") for k in range(1, 6) for t in range(10)] + [(42, t, f"whale{t}") for t in range(600)]
    put(spark, (catalog, ht, *lake[2:]), rows)
    parts = catalog.live_parts(ht.id)
    spans = sorted((p.key_min, p.key_max) for p in parts)
    if placement is None:
        assert spans == [(1, 42)]
    elif placement == 0:
        assert spans == [(k, k) for k in (1, 2, 3, 4, 5, 42)]
    else:
        whales = [s for s in spans if s[1] == 42]
        assert len(whales) > 3 and all(s == (42, 42) for s in whales)  # a key's own files hold nothing else
    assert sum(p.rows for p in parts) == len(rows) and misordered(spark, ht, parts) == []
    assert seen(spark, catalog, 2, "SELECT count(*) FROM events") == [(10,)] or placement is None


NOW = 1_780_000_000_000


def test_poison_stream(spark, lake, tmp_path):
    catalog, ht, root, _ = lake
    good = [json.dumps({"tenant_id": 1 + k % 2, "ts": NOW - k, "payload": f"v{k}", "extra": 1}) for k in range(30)]
    bad = ["this is not json", '{"tenant_id": 1, "payload": "no-ts"}', "", '{"ts": 5, "payload": "no-key"}', '{"tenant_id": "abc", "ts": 5}', '{"tenant_id": 1, "ts": "nope"}', json.dumps({"tenant_id": 1, "ts": NOW + 3_601_000})]
    records = spark.createDataFrame([("t", 0, k, v) for k, v in enumerate(itertools.chain(bad, good))], "topic string, partition int, offset long, value string")
    ingest = Ingest(spark, catalog, root, "events", lambda: NOW)
    assert ingest.batch(records).applied and not ingest.batch(records).applied
    assert ingest.skipped == len(bad) and ingest.freshest == NOW and catalog.offsets(ht.id) == {("t", 0): 37}
    assert sorted(seen(spark, catalog, None, "SELECT payload FROM events")) == sorted((f"v{k}",) for k in range(30))
    only_bad = spark.createDataFrame([("t", 0, 37, "no")], "topic string, partition int, offset long, value string")
    assert ingest.batch(only_bad).applied and catalog.offsets(ht.id) == {("t", 0): 38}
    with pytest.raises(OffsetRace):
        ingest.batch(spark.createDataFrame([("t", 0, 37, good[0]), ("t", 0, 40, good[1])], "topic string, partition int, offset long, value string"))

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text("\n".join(json.dumps({"tenant_id": 9, "ts": NOW - k, "payload": f"s{k}"}) for k in range(5)))
    for _ in range(2):
        ingest.start(json_lines(spark, str(source)), str(tmp_path / "ck")).awaitTermination()
    (source / "two.json").write_text(json.dumps({"tenant_id": 9, "ts": NOW - DAY, "payload": "t"}))
    ingest.start(json_lines(spark, str(source)), str(tmp_path / "ck")).awaitTermination()
    assert len(seen(spark, catalog, None, "SELECT payload FROM events WHERE tenant_id = 9")) == 6


def test_ingest_rules():
    cfg = IngestConfig()
    cases = {(0, 0, 10): "flush", (29, 5, 10): "flush", (30, 0, 10): "defer", (30, 1, 10): "flush", (199, 0, 10): "defer", (199, 1, 10): "flush", (200, 7, 10): "defer", (200, 7, 200_000): "flush"}
    assert {c: flush_decision(*c) for c in cases} == cases
    assert all(in_bounds(NOW + d, NOW) for d in (0, -DAY, 3_599_000)) and not any(in_bounds(t, NOW) for t in (NOW + 3_601_000, NOW - cfg.max_age_days * DAY - 1000, -(1 << 63), (1 << 63) - 1))
    assert assignment([2, 0, 1], [1, 2, 5], {1: 7}) == [(1, 7), (2, 0)] and assignment([1, 0], None, {}) == [(0, 0), (1, 0)]
