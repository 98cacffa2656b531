"""Every registered query with SQL beside it gives DuckDB's rows."""

import duckdb
import pytest

from spindrift.plans import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return tuple(map(canon, v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(canon(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(suite.ORACLE_SQL[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert got == want


def test_same_text_for_both_is_not_empty(spark):
    empty = [n for n in ("clicks_37", "clicks_41", "clicks_42", "clicks_43", "social_3", "tenant_top") if not suite.QUERIES[n](spark, "/root/testdata/sf0.01").head(1)]
    assert empty == []


def test_lake_ingests_every_user(spark, duck):
    sf = "/root/testdata/sf0.01"  # 150 users
    got = rows(["user_id", "c"], map(tuple, suite._ingest(spark, sf).sql("SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id").collect()))
    want = duck.execute(f"SELECT user_id, COUNT(*) AS c FROM '{sf}/events.parquet' WHERE event_id % 10 <> 0 AND event_id % 11 <> 0 GROUP BY 1").fetchall()
    assert len(want) == 150 and got == rows(["user_id", "c"], want)
