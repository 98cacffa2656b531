"""The HTTP endpoint and the bulk loads."""

import gzip
import json
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.operators.catalog import Catalog
from spindrift.plans import session
from spindrift.plans.server import ARROW, Server
from spindrift.sources.load import json_rows, key_of_text, load_parquet
from spindrift.sources.schema import TableColumns

COLUMNS = TableColumns.parse({"fields": [{"name": "shop", "type": "int64", "nullable": False}, {"name": "ts", "type": "timestamp_ms"}, {"name": "item", "type": "utf8"}]})


@pytest.fixture
def shops(spark, tmp_path):
    for k, rows in enumerate(([(1, 10, "pear", 0), (2, 20, "plum", 0)], [(1, 30, "fig", 0)])):
        spark.createDataFrame(rows, "shop int, at long, item string, other int").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    catalog = Catalog()
    ht = catalog.create_hypertable("sales", COLUMNS, ["shop", "ts"], "shop", partition_by=["day"], time="ts")
    commits = load_parquet(spark, catalog, ht, f"file://{tmp_path}/lake", [f"{tmp_path}/in0", f"{tmp_path}/in1"], {"day": F.lit("2026-02-02")}, rename={"at": "ts"})
    assert len(commits) == 2 and {p.level for p in catalog.live_parts(ht.id)} == {1}
    for ns in (1, 2):
        catalog.create_logical_table(ns, "sales", "sales")
    return catalog


def test_load_parquet(spark, shops):
    assert [tuple(r) for r in session.Namespace(spark, shops, 1).sql("SELECT shop, ts, item FROM sales ORDER BY ts").collect()] == [(1, 10, "pear"), (1, 30, "fig")]


def test_json_rows(spark, tmp_path):
    lines = [{"did": "u1", "time": 5, "commit": {"op": "create"}}, {"did": "u2", "time": "x"}, {"time": 7}, {"did": "", "time": 9, "extra": 1}]
    with gzip.open(tmp_path / "a.json.gz", "wt") as out:
        out.write("\n".join([*map(json.dumps, lines), "no json", ""]))
    df = json_rows(spark, str(tmp_path / "a.json.gz"), {"did": ("$.did", "string"), "ts": ("$.time", "bigint"), "op": ("$.commit.op", "string")}, ["did", "ts"])
    assert sorted(tuple(r) for r in df.select("did", "ts", F.coalesce("op", F.lit("-"))).collect()) == [("", 9, "-"), ("u1", 5, "create")]
    keys = [r[0] for r in spark.createDataFrame([(x,) for x in ("a", "a", "b", "", None)], "s string").select(key_of_text("s")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[4] is None and all(k >= 0 for k in keys[:4])


def call(url, body=None, accept=None):
    data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Accept": accept} if accept else {})) as r:
            return r.status, r.headers["Content-Type"], r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers["Content-Type"], e.read()


def test_server(spark, shops):
    server = Server(spark, shops, limits=session.Limits(60, 30))
    at = server.start()
    try:
        assert call(f"{at}/healthz")[0] == call(f"{at}/readyz")[0] == 200
        ask = {"namespace_id": 1, "sql": "SELECT item FROM sales ORDER BY ts"}
        status, _, body = call(f"{at}/api/query", ask)
        assert status == 200 and json.loads(body)["columns"] == {"item": ["pear", "fig"]}
        assert json.loads(call(f"{at}/api/query", {**ask, "format": "rows"})[2])["rows"] == [{"item": "pear"}, {"item": "fig"}]
        status, kind, body = call(f"{at}/api/query", ask, ARROW)
        assert kind == ARROW and pa.ipc.open_stream(body).read_all().to_pydict() == {"item": ["pear", "fig"]}
        assert json.loads(call(f"{at}/api/query", {**ask, "namespace_id": 2})[2])["columns"] == {"item": ["plum"]}
        for bad in (b"{", b"[]", {"sql": "SELECT 1"}, {**ask, "namespace_id": True}, {**ask, "format": "xml"}, {**ask, "format": 1}, {**ask, "sql": "DROP TABLE sales"}, {**ask, "sql": "SELECT nope FROM sales"}, {**ask, "sql": "SELECT * FROM parquet.`/tmp`"}):
            status, _, body = call(f"{at}/api/query", bad)
            assert status == 400 and json.loads(body)["retryable"] is False, bad
        assert call(f"{at}/nope")[0] == call(f"{at}/nope", ask)[0] == 404
        assert call(f"{at}/api/query", b"x" * (1 << 20) + b"x")[0] == 413
    finally:
        server.shutdown()
        server.server_close()
