"""The registered queries of the engine itself, and their SQL for DuckDB.

A query is written once where the dialects agree; `{name}` stands for a table.  Where they differ, the DuckDB
text is given beside it.  Every result has a total order or is compared as a set.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import fill
from spindrift.operators.catalog import Catalog, Hypertable
from spindrift.operators.maintenance import Compactor, Policy, delete_key
from spindrift.operators.pruning import ColumnRange
from spindrift.operators.writer import day, write
from spindrift.plans.session import Namespace
from spindrift.sources.schema import TableColumns
from spindrift.streaming.ingest import Ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TABLE = re.compile(r"\{(\w+)\}")

# Web hits made of the star schema: the columns of a click log, with its names.
_HITS = """
SELECT l_suppkey % 100 AS "CounterID", {seconds} AS "EventTime", {days} AS "EventDate", l_partkey AS "UserID", l_orderkey * 10 + l_linenumber AS "WatchID",
 l_suppkey * 7919 % 1000 AS "ClientIP", l_partkey % 50 * 1000003 AS "URLHash", l_suppkey % 7 * 5000011 AS "RefererHash",
 CASE WHEN l_linenumber = 7 THEN l_suppkey % 20 ELSE 0 END AS "AdvEngineID", CAST(l_quantity AS BIGINT) * 32 AS "ResolutionWidth", l_partkey % 23 AS "RegionID",
 l_partkey % 9 AS "MobilePhone", CASE WHEN l_linenumber > 4 THEN l_partkey % 5 ELSE 0 END AS "SearchEngineID", CAST(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS BIGINT) AS "IsRefresh",
 CAST(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS BIGINT) AS "DontCountHits", CAST(CASE WHEN l_linenumber < 4 THEN 1 ELSE 0 END AS BIGINT) AS "IsLink", CAST(CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS BIGINT) AS "IsDownload",
 l_suppkey % 8 - 1 AS "TraficSourceID", l_partkey % 11 * 100 AS "WindowClientWidth", l_partkey % 6 * 100 AS "WindowClientHeight",
 CASE WHEN l_partkey % 3 = 0 THEN concat('model', CAST(l_partkey % 12 AS STRING)) ELSE '' END AS "MobilePhoneModel",
 CASE WHEN l_linenumber > 3 THEN concat('phrase ', l_returnflag, CAST(l_partkey % 40 AS STRING)) ELSE '' END AS "SearchPhrase",
 concat('http://', CASE WHEN l_partkey % 13 = 0 THEN 'www.google.' ELSE 'site.' END, CAST(l_partkey % 50 AS STRING), '/p', CAST(l_linenumber AS STRING)) AS "URL",
 concat(CASE WHEN l_partkey % 17 = 0 THEN 'Google ' ELSE 'Page ' END, CAST(l_partkey % 60 AS STRING)) AS "Title",
 CASE WHEN l_linenumber = 1 THEN '' ELSE concat('https://www.ref', CAST(l_suppkey % 7 AS STRING), '.com/a/', CAST(l_linenumber AS STRING)) END AS "Referer"
FROM {lineitem}
"""
_HITS_SPARK = _HITS.replace("{seconds}", "unix_timestamp(CAST(l_shipdate AS TIMESTAMP))").replace("{days}", "CAST(unix_timestamp(CAST(l_shipdate AS TIMESTAMP)) div 86400 AS BIGINT)")
_HITS_DUCK = _HITS.replace("{seconds}", "(epoch_us(l_shipdate) // 1000000)").replace("{days}", "(epoch_us(l_shipdate) // 86400000000)")
_BSKY_SPARK = "SELECT event_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ts, user_id AS tenant_id, concat('did:', CAST(user_id AS STRING)) AS did, event_type AS collection, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'create' END AS operation, props AS payload FROM {events}"
_BSKY_DUCK = _BSKY_SPARK.replace("unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(ts) // 1000")
_VIEWS = {"hits": (_HITS_SPARK, _HITS_DUCK), "bsky": (_BSKY_SPARK, _BSKY_DUCK)}


def _quoted(sql: str) -> str:
    return re.sub(r'"(\w+)"', r"`\1`", sql)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables of a folder; `{hits}` and `{bsky}` are the derived ones."""
    frames: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = run_sql(spark, sf_dir, _VIEWS[name][0]) if name in _VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    names = set(_TABLE.findall(sql))
    return spark.sql(_quoted(sql), **{n: frame(n) for n in names})


def _duck(sql: str) -> str:
    sql = re.sub(r"\bSTRING\b", "VARCHAR", sql)
    for name, (_, text) in _VIEWS.items():
        if f"{{{name}}}" in sql:
            sql = sql.replace(f"{{{name}}}", f"({_duck(text)})")
    return _TABLE.sub(r"\1", sql)


def add(name: str, sql: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLE_SQL[name] = _duck(duck or sql)


# Click-log suite: each statement of the benchmark over the stand-in, with ties broken.
_SUMS = ", ".join(f'CAST(SUM("ResolutionWidth" + {k}) AS BIGINT) AS s{k}' for k in range(90))
_FROM = "FROM {hits} AS hits_cb"
_RANGE = '"CounterID" = 62 AND "EventDate" >= {lo} AND "EventDate" <= {hi}'.replace("{lo}", "8000").replace("{hi}", "10000")
_CB = {
    1: f"SELECT COUNT(*) AS c {_FROM}",
    2: f'SELECT COUNT(*) AS c {_FROM} WHERE "AdvEngineID" <> 0',
    3: f'SELECT CAST(SUM("AdvEngineID") AS BIGINT) AS s, COUNT(*) AS c, ROUND(AVG("ResolutionWidth"), 6) AS a {_FROM}',
    4: f'SELECT ROUND(AVG("UserID"), 6) AS a {_FROM}',
    5: f'SELECT COUNT(DISTINCT "UserID") AS u {_FROM}',
    6: f'SELECT COUNT(DISTINCT "SearchPhrase") AS u {_FROM}',
    7: f'SELECT MIN("EventDate") AS lo, MAX("EventDate") AS hi {_FROM}',
    8: f'SELECT "AdvEngineID", COUNT(*) AS c {_FROM} WHERE "AdvEngineID" <> 0 GROUP BY "AdvEngineID" ORDER BY c DESC, 1',
    9: f'SELECT "RegionID", COUNT(DISTINCT "UserID") AS u {_FROM} GROUP BY "RegionID" ORDER BY u DESC, 1 LIMIT 10',
    10: f'SELECT "RegionID", CAST(SUM("AdvEngineID") AS BIGINT) AS s, COUNT(*) AS c, ROUND(AVG("ResolutionWidth"), 6) AS a, COUNT(DISTINCT "UserID") AS u {_FROM} GROUP BY "RegionID" ORDER BY c DESC, 1 LIMIT 10',
    11: f'SELECT "MobilePhoneModel", COUNT(DISTINCT "UserID") AS u {_FROM} WHERE "MobilePhoneModel" <> \'\' GROUP BY 1 ORDER BY u DESC, 1 LIMIT 10',
    12: f'SELECT "MobilePhone", "MobilePhoneModel", COUNT(DISTINCT "UserID") AS u {_FROM} WHERE "MobilePhoneModel" <> \'\' GROUP BY 1, 2 ORDER BY u DESC, 1, 2 LIMIT 10',
    13: f'SELECT "SearchPhrase", COUNT(*) AS c {_FROM} WHERE "SearchPhrase" <> \'\' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10',
    14: f'SELECT "SearchPhrase", COUNT(DISTINCT "UserID") AS u {_FROM} WHERE "SearchPhrase" <> \'\' GROUP BY 1 ORDER BY u DESC, 1 LIMIT 10',
    15: f'SELECT "SearchEngineID", "SearchPhrase", COUNT(*) AS c {_FROM} WHERE "SearchPhrase" <> \'\' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10',
    16: f'SELECT "UserID", COUNT(*) AS c {_FROM} GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10',
    17: f'SELECT "UserID", "SearchPhrase", COUNT(*) AS c {_FROM} GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10',
    18: f'SELECT "UserID", "SearchPhrase", COUNT(*) AS c {_FROM} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10',
    19: f'SELECT "UserID", CAST(extract(minute FROM timestamp_seconds("EventTime")) AS BIGINT) AS m, "SearchPhrase", COUNT(*) AS c {_FROM} GROUP BY 1, 2, 3 ORDER BY c DESC, 1, 2, 3 LIMIT 10',
    20: f'SELECT "UserID" {_FROM} WHERE "UserID" = 77',
    21: f"SELECT COUNT(*) AS c {_FROM} WHERE \"URL\" LIKE '%google%'",
    22: f"SELECT \"SearchPhrase\", MIN(\"URL\") AS u, COUNT(*) AS c {_FROM} WHERE \"URL\" LIKE '%google%' AND \"SearchPhrase\" <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    23: f"SELECT \"SearchPhrase\", MIN(\"URL\") AS u, MIN(\"Title\") AS t, COUNT(*) AS c, COUNT(DISTINCT \"UserID\") AS d {_FROM} WHERE \"Title\" LIKE '%Google%' AND \"URL\" NOT LIKE '%.google.%' AND \"SearchPhrase\" <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    24: f"SELECT * {_FROM} WHERE \"URL\" LIKE '%google%' ORDER BY \"EventTime\", \"WatchID\" LIMIT 10",
    25: f'SELECT "SearchPhrase" {_FROM} WHERE "SearchPhrase" <> \'\' ORDER BY "EventTime", "WatchID" LIMIT 10',
    26: f'SELECT "SearchPhrase" {_FROM} WHERE "SearchPhrase" <> \'\' ORDER BY "SearchPhrase" LIMIT 10',
    27: f'SELECT "SearchPhrase" {_FROM} WHERE "SearchPhrase" <> \'\' ORDER BY "EventTime", "SearchPhrase" LIMIT 10',
    28: f'SELECT "CounterID", ROUND(AVG(length("URL")), 6) AS l, COUNT(*) AS c {_FROM} WHERE "URL" <> \'\' GROUP BY 1 HAVING COUNT(*) > 10 ORDER BY l DESC, 1 LIMIT 25',
    29: f"SELECT REGEXP_REPLACE(\"Referer\", '^https?://(?:www[.])?([^/]+)/.*$', '$1') AS k, ROUND(AVG(length(\"Referer\")), 6) AS l, COUNT(*) AS c, MIN(\"Referer\") AS r {_FROM} WHERE \"Referer\" <> '' GROUP BY 1 HAVING COUNT(*) > 10 ORDER BY l DESC, 1 LIMIT 25",
    30: f"SELECT {_SUMS} {_FROM}",
    31: f'SELECT "SearchEngineID", "ClientIP", COUNT(*) AS c, CAST(SUM("IsRefresh") AS BIGINT) AS s, ROUND(AVG("ResolutionWidth"), 6) AS a {_FROM} WHERE "SearchPhrase" <> \'\' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10',
    32: f'SELECT "WatchID", "ClientIP", COUNT(*) AS c, CAST(SUM("IsRefresh") AS BIGINT) AS s, ROUND(AVG("ResolutionWidth"), 6) AS a {_FROM} WHERE "SearchPhrase" <> \'\' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10',
    33: f'SELECT "WatchID", "ClientIP", COUNT(*) AS c, CAST(SUM("IsRefresh") AS BIGINT) AS s, ROUND(AVG("ResolutionWidth"), 6) AS a {_FROM} GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10',
    34: f'SELECT "URL", COUNT(*) AS c {_FROM} GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10',
    35: f'SELECT 1 AS one, "URL", COUNT(*) AS c {_FROM} GROUP BY 1, 2 ORDER BY c DESC, 2 LIMIT 10',
    36: f'SELECT "ClientIP", "ClientIP" - 1 AS a, "ClientIP" - 2 AS b, "ClientIP" - 3 AS d, COUNT(*) AS c {_FROM} GROUP BY 1, 2, 3, 4 ORDER BY c DESC, 1 LIMIT 10',
    37: f'SELECT "URL", COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "DontCountHits" = 0 AND "IsRefresh" = 0 AND "URL" <> \'\' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10',
    38: f'SELECT "Title", COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "DontCountHits" = 0 AND "IsRefresh" = 0 AND "Title" <> \'\' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10',
    39: f'SELECT "URL", COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "IsRefresh" = 0 AND "IsLink" <> 0 AND "IsDownload" = 0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10 OFFSET 10',
    40: f'SELECT "TraficSourceID", "SearchEngineID", "AdvEngineID", CASE WHEN ("SearchEngineID" = 0 AND "AdvEngineID" = 0) THEN "Referer" ELSE \'\' END AS src, "URL" AS dst, COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "IsRefresh" = 0 GROUP BY 1, 2, 3, 4, 5 ORDER BY n DESC, 1, 2, 3, 4, 5 LIMIT 10 OFFSET 10',
    41: f'SELECT "URLHash", "EventDate", COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "IsRefresh" = 0 AND "TraficSourceID" IN (-1, 5) AND "RefererHash" = 30000066 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10 OFFSET 10',
    42: f'SELECT "WindowClientWidth", "WindowClientHeight", COUNT(*) AS n {_FROM} WHERE {_RANGE} AND "IsRefresh" = 0 AND "DontCountHits" = 0 AND "URLHash" < 30000000 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10 OFFSET 10',
    43: f"SELECT CAST(date_trunc('minute', timestamp_seconds(\"EventTime\")) AS TIMESTAMP_NTZ) AS m, COUNT(*) AS n {_FROM} WHERE {_RANGE} AND \"IsRefresh\" = 0 AND \"DontCountHits\" = 0 GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10",
}
for _n, _sql in _CB.items():
    add(f"clicks_{_n:02}", _sql, _sql.replace("timestamp_seconds(", "make_timestamp(1000000 * ").replace("'$1'", "'\\1'").replace("TIMESTAMP_NTZ", "TIMESTAMP"))

# Social-event suite.
_EV = "FROM {bsky} AS bsky"
for _name, _sql in {
    "social_1": f"SELECT collection, COUNT(*) AS c {_EV} GROUP BY 1 ORDER BY c DESC, 1",
    "social_2": f"SELECT collection, COUNT(*) AS c, COUNT(DISTINCT did) AS u {_EV} WHERE operation = 'create' GROUP BY 1 ORDER BY c DESC, 1",
    "social_3": f"SELECT collection, CAST(extract(hour FROM timestamp_millis(ts)) AS BIGINT) AS h, COUNT(*) AS c {_EV} WHERE operation = 'create' AND collection IN ('click', 'view', 'purchase') GROUP BY 1, 2 ORDER BY h, collection",
    "social_4": f"SELECT did, CAST(MIN(timestamp_millis(ts)) AS TIMESTAMP_NTZ) AS first_at {_EV} WHERE operation = 'create' GROUP BY 1 ORDER BY first_at, did LIMIT 3",
    "social_5": f"SELECT did, MAX(ts) - MIN(ts) AS span {_EV} WHERE operation = 'create' GROUP BY 1 ORDER BY span DESC, did LIMIT 3",
    "tenant_count": f"SELECT COUNT(*) AS c {_EV} WHERE tenant_id = 7",
    "tenant_filter": f"SELECT COUNT(*) AS c {_EV} WHERE tenant_id = 7 AND collection <> 'view'",
    "tenant_distinct": f"SELECT COUNT(DISTINCT did) AS u {_EV}",
    "tenant_top": f"SELECT collection, COUNT(*) AS c {_EV} WHERE tenant_id = 7 GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    "tenant_window": f"SELECT COUNT(*) AS c {_EV} WHERE tenant_id = 7 AND ts BETWEEN 1704500000000 AND 1706000000000",
    "tenant_minutely": f"SELECT ts DIV 60000 AS minute, COUNT(*) AS c {_EV} WHERE tenant_id = 7 GROUP BY 1 ORDER BY 1",
    "narrow_projection": f"SELECT ts {_EV} WHERE tenant_id = 11",
    "order_by_limit": f"SELECT ts, payload {_EV} WHERE tenant_id = 11 ORDER BY ts, event_id LIMIT 100",
}.items():
    add(_name, _sql, _sql.replace("timestamp_millis(", "make_timestamp(1000 * ").replace(" DIV ", " // ").replace("TIMESTAMP_NTZ", "TIMESTAMP"))

# Joins, windows, set operations, grouping, subqueries: what the gateway's SQL reaches.
_STAR = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
for _name, _sql, *_other in [
    ("flagship", f"SELECT r_name, n_name, COUNT(*) AS lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {_STAR} WHERE o_orderstatus <> 'P' GROUP BY 1, 2"),
    ("join_inner", "SELECT n_name, COUNT(*) AS c FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1"),
    ("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY 1"),
    ("join_right", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey GROUP BY 1"),
    ("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey"),
    ("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}"),
    ("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    ("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    ("join_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)"),
    ("join_range", "SELECT a.event_id AS a, b.event_id AS b FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"),
    ("join_lateral_max", "SELECT c_custkey, m.last_key FROM {customer} LEFT JOIN (SELECT o_custkey, MAX(o_orderkey) AS last_key FROM {orders} GROUP BY 1) m ON m.o_custkey = c_custkey"),
    ("subquery_scalar", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)"),
    ("predicates", "SELECT p_partkey FROM {part} WHERE (p_size > 45 OR NOT p_brand = 'Brand#11') AND p_name IS NOT NULL AND p_type ILIKE '%A%' AND p_retailprice BETWEEN 900 AND 1500"),
    ("regex_filter", "SELECT page_id FROM {pages} WHERE url RLIKE 'page=[0-9]+'", "SELECT page_id FROM {pages} WHERE regexp_matches(url, 'page=[0-9]+')"),
    ("agg_filter", "SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) AS c FROM {events} GROUP BY 1"),
    ("agg_stats", "SELECT event_type, ROUND(STDDEV(value), 6) AS sd, ROUND(VAR_SAMP(value), 6) AS v, ROUND(CORR(value, user_id), 6) AS r, BOOL_AND(value > 0) AS pos, BOOL_OR(value > 50) AS high, BIT_AND(event_id) AS ba, BIT_OR(event_id) AS bo, BIT_XOR(event_id) AS bx FROM {events} GROUP BY 1"),
    ("agg_median", "SELECT event_type, ROUND(MEDIAN(value), 6) AS m FROM {events} GROUP BY 1"),
    ("agg_distinct_then_count", "SELECT user_id, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM {events}) d GROUP BY 1"),
    ("agg_max_of_counts", "SELECT MAX(c) AS most FROM (SELECT user_id, COUNT(*) AS c FROM {events} GROUP BY 1) g"),
    ("agg_array", "SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS keys FROM {nation} GROUP BY 1", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys FROM {nation} GROUP BY 1"),
    ("agg_string", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY 1", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY 1"),
    ("agg_first_last", "SELECT user_id, MIN_BY(event_id, ts) AS f, MAX_BY(event_id, ts) AS l FROM {events} GROUP BY 1"),
    ("group_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    ("group_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("group_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    ("window_rank", "SELECT event_id, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr, NTILE(4) OVER w AS q, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rn, CAST(RANK() OVER w AS INTEGER) AS rk, CAST(DENSE_RANK() OVER w AS INTEGER) AS dr, CAST(NTILE(4) OVER w AS INTEGER) AS q, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    ("window_analytic", "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, FIRST_VALUE(event_id) OVER w AS f, LAST_VALUE(event_id) OVER w AS l, NTH_VALUE(event_id, 2) OVER w AS n FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("window_frames", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS c FROM {events}"),
    ("window_top_per_group", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM {events}) t WHERE rn <= 3"),
    ("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}"),
    ("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}"),
    ("set_intersect", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders}"),
    ("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000"),
    ("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}"),
    ("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}"),
    ("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, (SELECT COUNT(*) FROM {nation} WHERE n_nationkey < n) AS c FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, c.c FROM t, LATERAL (SELECT COUNT(*) AS c FROM {nation} WHERE n_nationkey < t.n) c"),
    ("values_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}"),
    ("nulls_last", "SELECT c_custkey, MIN(o_orderkey) AS k FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 NULLS LAST, 1"),
    ("pricing_summary", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice), 2) AS p, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS c FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2"),
    # Scalar functions
    ("fn_string", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, ltrim(concat(' ', n_name)) AS lt, rtrim(concat(n_name, ' ')) AS rt, substr(n_name, 2, 3) AS ss, left(n_name, 2) AS le, right(n_name, 2) AS ri, replace(n_name, 'A', 'x') AS rp, translate(n_name, 'AE', 'ae') AS tr, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rd, repeat(n_name, 2) AS rr, reverse(n_name) AS rv, concat_ws('-', n_name, 'x') AS cw, CAST(ascii(n_name) AS BIGINT) AS ac, chr(65) AS ch, CAST(levenshtein(n_name, 'PERU') AS BIGINT) AS lv, CAST(length(n_name) AS BIGINT) AS ln, contains(n_name, 'AN') AS cn FROM {nation}"),
    ("fn_string2", "SELECT n_nationkey, split_part(n_name, 'A', 1) AS sp, CAST(instr(n_name, 'A') AS BIGINT) AS po, startswith(n_name, 'A') AS sw, endswith(n_name, 'A') AS ew, CAST(octet_length(n_name) AS BIGINT) AS ol, CAST(bit_length(n_name) AS BIGINT) AS bl FROM {nation}", "SELECT n_nationkey, split_part(n_name, 'A', 1) AS sp, CAST(instr(n_name, 'A') AS BIGINT) AS po, starts_with(n_name, 'A') AS sw, suffix(n_name, 'A') AS ew, CAST(strlen(n_name) AS BIGINT) AS ol, CAST(bit_length(n_name) AS BIGINT) AS bl FROM {nation}"),
    ("fn_regex", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS masked, regexp_like(url, 'utm') AS utm, CAST(regexp_count(url, '/') AS BIGINT) AS n FROM {pages}", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, 'utm') AS utm, CAST(len(regexp_extract_all(url, '/')) AS BIGINT) AS n FROM {pages}"),
    ("fn_date", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(extract(minute FROM ts) AS BIGINT) AS mi, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(ts AS DATE) AS d, make_date(2024, 2, 29) AS md, date_format(ts, 'yyyy-MM-dd') AS s, ts + INTERVAL 90 MINUTES AS later FROM {events}", "SELECT event_id, year(ts) AS y, extract(minute FROM ts) AS mi, date_trunc('hour', ts) AS h, CAST(ts AS DATE) AS d, make_date(2024, 2, 29) AS md, strftime(ts, '%Y-%m-%d') AS s, ts + INTERVAL 90 MINUTES AS later FROM {events}"),
    ("fn_date_bin", "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS bin, COUNT(*) AS c FROM (SELECT window(ts, '15 minutes') AS w FROM {events}) t GROUP BY 1", "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS bin, COUNT(*) AS c FROM {events} GROUP BY 1"),
    ("fn_math", "SELECT event_id, abs(-value) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, ROUND(value, 1) AS r, CAST(sign(value) AS DOUBLE) AS s, ROUND(sqrt(abs(value)), 6) AS q, ROUND(cbrt(value), 6) AS cb, ROUND(exp(value / 100), 6) AS e, ROUND(ln(abs(value) + 1), 6) AS l, ROUND(log2(abs(value) + 1), 6) AS l2, ROUND(log10(abs(value) + 1), 6) AS l10, ROUND(power(value, 2), 4) AS p, event_id % 7 AS m, ROUND(sin(value), 6) AS si, ROUND(atan2(value, 2), 6) AS at, ROUND(pi(), 6) AS pi FROM {events}", "SELECT event_id, abs(-value) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, ROUND(value, 1) AS r, CAST(sign(value) AS DOUBLE) AS s, ROUND(sqrt(abs(value)), 6) AS q, ROUND(cbrt(value), 6) AS cb, ROUND(exp(value / 100), 6) AS e, ROUND(ln(abs(value) + 1), 6) AS l, ROUND(log2(abs(value) + 1), 6) AS l2, ROUND(log10(abs(value) + 1), 6) AS l10, ROUND(power(value, 2), 4) AS p, event_id % 7 AS m, ROUND(sin(value), 6) AS si, ROUND(atan2(value, 2), 6) AS at, ROUND(pi(), 6) AS pi FROM {events}"),
    ("fn_conditional", "SELECT c_custkey, coalesce(NULL, c_name) AS co, nullif(c_nationkey, 3) AS nu, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k, TRY_CAST(c_name AS INT) AS tc FROM {customer}"),
    ("fn_array", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS first, slice(embedding, 2, 3) AS part, array_contains(array(1, 2, label), label) AS has, array_join(array('a', 'b'), '+') AS joined FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, embedding[2:4] AS part, list_contains([1, 2, label], label) AS has, array_to_string(['a', 'b'], '+') AS joined FROM {embeddings}"),
    ("fn_unnest", "SELECT label, COUNT(*) AS n, ROUND(SUM(x), 3) AS s FROM (SELECT label, explode(embedding) AS x FROM {embeddings}) t GROUP BY 1", "SELECT label, COUNT(*) AS n, ROUND(SUM(x), 3) AS s FROM (SELECT label, unnest(embedding) AS x FROM {embeddings}) t GROUP BY 1"),
    ("fn_hash", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, base64(CAST(n_name AS BINARY)) AS b, lower(hex(n_nationkey)) AS h FROM {nation}", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, base64(encode(n_name)) AS b, lower(to_hex(n_nationkey)) AS h FROM {nation}"),
    ("fn_json", "SELECT event_type, CAST(SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM {events} GROUP BY 1", "SELECT event_type, CAST(SUM(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS s FROM {events} GROUP BY 1"),
    ("fn_types", "SELECT typeof(l_quantity) AS a, COUNT(*) AS c FROM {lineitem} GROUP BY 1", "SELECT lower(typeof(l_quantity)) AS a, COUNT(*) AS c FROM {lineitem} GROUP BY 1"),
    ("fn_string3", "SELECT n_nationkey, initcap(lower(n_name)) AS ic, btrim(concat(' ', n_name, ' ')) AS bt, CAST(position('A' IN n_name) AS BIGINT) AS po, nvl(nullif(n_name, 'PERU'), 'none') AS nv, nvl2(nullif(n_name, 'PERU'), 'some', 'none') AS n2 FROM {nation}", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS ic, trim(' ' || n_name || ' ') AS bt, position('A' IN n_name) AS po, CASE WHEN n_name = 'PERU' THEN 'none' ELSE n_name END AS nv, CASE WHEN n_name = 'PERU' THEN 'none' ELSE 'some' END AS n2 FROM {nation}"),
    ("fn_date2", "SELECT event_id, CAST(date_part('month', ts) AS BIGINT) AS mo, to_date(date_format(ts, 'yyyy-MM-dd')) AS d, CAST(quarter(ts) AS BIGINT) AS q, CAST(dayofweek(ts) AS BIGINT) AS w, last_day(ts) AS ld, CAST(datediff(ts, DATE '2024-01-01') AS BIGINT) AS dd FROM {events}", "SELECT event_id, date_part('month', ts) AS mo, CAST(ts AS DATE) AS d, quarter(ts) AS q, dayofweek(ts) + 1 AS w, last_day(ts) AS ld, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dd FROM {events}"),
    ("fn_math2", "SELECT n_nationkey, factorial(n_regionkey) AS f, bround(CAST(n_nationkey AS DOUBLE) / 2, 0) AS b, ROUND(degrees(n_nationkey), 6) AS de, ROUND(radians(n_nationkey), 6) AS ra, ROUND(tanh(n_nationkey), 6) AS th, ROUND(cot(n_nationkey + 1), 6) AS ct, isnan(CAST('NaN' AS DOUBLE)) AS nn FROM {nation}", "SELECT n_nationkey, CAST(factorial(CAST(n_regionkey AS INTEGER)) AS BIGINT) AS f, round_even(CAST(n_nationkey AS DOUBLE) / 2, 0) AS b, ROUND(degrees(n_nationkey), 6) AS de, ROUND(radians(n_nationkey), 6) AS ra, ROUND(tanh(n_nationkey), 6) AS th, ROUND(cot(n_nationkey + 1), 6) AS ct, isnan(CAST('NaN' AS DOUBLE)) AS nn FROM {nation}"),
    ("fn_array2", "SELECT n_nationkey, array_sort(array_distinct(a)) AS di, array_min(a) AS mi, array_max(a) AS ma, CAST(array_position(a, 3) AS BIGINT) AS po, array_append(a, 9) AS ap, concat(a, array(7)) AS co, array_sort(array_intersect(a, array(1, 2, 3))) AS ins, array_sort(array_except(a, array(1, 2, 3))) AS ex, array_remove(a, 3) AS re, array_repeat(n_name, 2) AS rp, flatten(array(a, array(5))) AS fl, reverse(a) AS rv FROM (SELECT *, array(CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 3) AS a FROM {nation}) t", "SELECT n_nationkey, list_sort(list_distinct(a)) AS di, list_min(a) AS mi, list_max(a) AS ma, CAST(list_position(a, 3) AS BIGINT) AS po, list_append(a, 9) AS ap, list_concat(a, [7]) AS co, list_sort(list_intersect(a, [1, 2, 3])) AS ins, list_sort(list_distinct(list_filter(a, lambda x: x NOT IN (1, 2, 3)))) AS ex, list_filter(a, lambda x: x <> 3) AS re, [n_name, n_name] AS rp, flatten([a, [5]]) AS fl, list_reverse(a) AS rv FROM (SELECT *, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 3] AS a FROM {nation}) t"),
    ("fn_map_struct", "SELECT n_nationkey, map_keys(m) AS ks, map_values(m) AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains_key(m, 'b') AS has, named_struct('x', n_name, 'y', n_regionkey).x AS sx FROM (SELECT *, map('a', n_nationkey, 'b', n_regionkey) AS m FROM {nation}) t", "SELECT n_nationkey, map_keys(m) AS ks, map_values(m) AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains(m, 'b') AS has, struct_pack(x := n_name, y := n_regionkey).x AS sx FROM (SELECT *, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM {nation}) t"),
    ("agg_regression", "SELECT event_type, ROUND(COVAR_SAMP(value, user_id), 5) AS cs, ROUND(COVAR_POP(value, user_id), 5) AS cp, ROUND(REGR_SLOPE(value, user_id), 6) AS sl, ROUND(REGR_INTERCEPT(value, user_id), 5) AS ic, ROUND(REGR_R2(value, user_id), 6) AS r2, REGR_COUNT(value, user_id) AS n FROM {events} GROUP BY 1", "SELECT event_type, ROUND(COVAR_SAMP(value, user_id), 5) AS cs, ROUND(COVAR_POP(value, user_id), 5) AS cp, ROUND(REGR_SLOPE(value, user_id), 6) AS sl, ROUND(REGR_INTERCEPT(value, user_id), 5) AS ic, ROUND(REGR_R2(value, user_id), 6) AS r2, CAST(REGR_COUNT(value, user_id) AS BIGINT) AS n FROM {events} GROUP BY 1"),
    # Sketches are no exact values: the query says whether they lie within their error of the exact ones.
    ("agg_approximate", "SELECT event_type, ABS(APPROX_COUNT_DISTINCT(user_id) - COUNT(DISTINCT user_id)) <= 0.15 * COUNT(DISTINCT user_id) AS distinct_near, PERCENTILE_APPROX(value, 0.5, 10000) BETWEEN PERCENTILE(value, 0.45) AND PERCENTILE(value, 0.55) AS median_near FROM {events} GROUP BY 1", "SELECT DISTINCT event_type, TRUE AS distinct_near, TRUE AS median_near FROM {events}"),
    ("values_rows", "SELECT v.k, COUNT(n_nationkey) AS c FROM VALUES (0, 'a'), (1, 'b'), (9, 'c') AS v(r, k) LEFT JOIN {nation} ON n_regionkey = v.r GROUP BY 1", "SELECT v.k, COUNT(n_nationkey) AS c FROM (VALUES (0, 'a'), (1, 'b'), (9, 'c')) AS v(r, k) LEFT JOIN {nation} ON n_regionkey = v.r GROUP BY 1"),
    ("int_division", "SELECT o_orderkey DIV 7 AS q, o_orderkey % 7 AS r, COUNT(*) AS c FROM {orders} GROUP BY 1, 2", "SELECT o_orderkey // 7 AS q, o_orderkey % 7 AS r, COUNT(*) AS c FROM {orders} GROUP BY 1, 2"),
]:
    add(_name, _sql, *_other)


def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gcd and lcm, which Spark lacks: Euclid's steps as one aggregate over a bounded array."""
    a, b = F.abs(F.col("l_partkey")), F.abs(F.col("l_suppkey"))
    # 64-bit arguments take under 93 steps.
    step = F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.when(s.y == 0, 1).otherwise(s.y)).alias("y"))))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    return rows.withColumn("g", step.x).withColumn("l", F.when(F.col("g") == 0, 0).otherwise(a / F.col("g") * b).cast("long"))


QUERIES["fn_gcd_lcm"] = gcd_lcm
ORACLE_SQL["fn_gcd_lcm"] = "SELECT DISTINCT l_partkey, l_suppkey, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l FROM lineitem"

# Lake queries: each writes a lake of its own under the shared folder, then asks it.
_COLUMNS = TableColumns.parse(
    {
        "fields": [
            {"name": "user_id", "type": "int64", "nullable": False},
            {"name": "ts", "type": "timestamp_ms"},
            {"name": "event_id", "type": "int64"},
            {"name": "event_type", "type": "utf8"},
            {"name": "value", "type": "float64", "default": "0.0"},
            {"name": "doubled", "type": "float64", "materialized": "value * 2.0"},
            {"name": "half", "type": "float64", "alias": "value / 2.0"},
        ]
    }
)


def _root(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        raise RuntimeError("spark.checkpoint.dir names no folder for the lake's files")
    return f"{at if ':' in at else 'file://' + at}/lake-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))


def _lake(spark: SparkSession, sf_dir: str, commits: int = 2) -> tuple[Catalog, Hypertable, str]:
    """`events` as a hypertable by user and month, in `commits` commits."""
    catalog, root = Catalog(), _root(spark)
    ht = catalog.create_hypertable("events", _COLUMNS, ["user_id", "ts"], "user_id", partition_by=["month"], time="ts")
    rows = fill(_events(spark, sf_dir), _COLUMNS).withColumn("month", F.substring(day("ts"), 1, 7))
    for k in range(commits):
        catalog.commit(ht.id, write(spark, catalog, ht, root, rows.where(F.col("event_id") % commits == k)))
    return catalog, ht, root


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, _ = _lake(spark, sf_dir)
    catalog.create_logical_table(7, "events", "events")
    return Namespace(spark, catalog, 7).sql("SELECT event_type, COUNT(*) AS c, MIN(ts) AS lo, MAX(ts) AS hi FROM events GROUP BY event_type")


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, _ = _lake(spark, sf_dir)
    catalog.create_logical_table(9, "events", "events")
    ranges = {"events": [ColumnRange("ts", 1_704_500_000_000, 1_706_000_000_000)]}
    return Namespace(spark, catalog, 9, ranges).sql("SELECT event_id, ts FROM events WHERE ts BETWEEN 1704500000000 AND 1706000000000")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, _ = _lake(spark, sf_dir)
    return Namespace(spark, catalog, None).sql("SELECT event_id, value, doubled, half FROM events WHERE half > 10.0")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, root = _lake(spark, sf_dir)
    assert Compactor(spark, catalog, root, policy=Policy(2, 2)).compact_once("events") > 0
    return Namespace(spark, catalog, None).sql("SELECT user_id, COUNT(*) AS c, MIN(ts) AS lo, MAX(ts) AS hi FROM events GROUP BY user_id")


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, root = _lake(spark, sf_dir)
    delete_key(spark, catalog, root, "events", 7)
    return Namespace(spark, catalog, None).sql("SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, _ = _lake(spark, sf_dir)
    return Namespace(spark, catalog, None, as_of=catalog.changes_since(ht.id)[0]["commit"]).sql("SELECT COUNT(*) AS c, MIN(event_id) AS lo FROM events")


def _ingest(spark: SparkSession, sf_dir: str) -> Namespace:
    """All of `events` as JSON records with poison among them: every tenth has no time, every eleventh key is text."""
    catalog, root = Catalog(), _root(spark)
    ht = catalog.create_hypertable("events", _COLUMNS, ["user_id", "ts"], "user_id", partition_by=["day"], time="ts")
    e = _events(spark, sf_dir)
    good = F.to_json(F.struct("user_id", "ts", "event_id", "event_type", "value"))
    value = F.when(F.col("event_id") % 10 == 0, F.to_json(F.struct("user_id", "event_id"))).when(F.col("event_id") % 11 == 0, F.to_json(F.struct(F.lit("x").alias("user_id"), "ts"))).otherwise(good)
    records = e.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), value.alias("value"))
    ingest = Ingest(spark, catalog, root, "events", lambda: 1_740_000_000_000)
    ingest.batch(records)
    ingest.batch(records)  # a replay changes nothing
    return Namespace(spark, catalog, None)


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir).sql("SELECT user_id, COUNT(*) AS c, ROUND(SUM(doubled), 4) AS d FROM events GROUP BY user_id")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, ht, root = _lake(spark, sf_dir, 3)
    rows = [(sum(p.rows for p in c["added"]), c["kind"]) for c in catalog.changes_since(ht.id)]
    return spark.createDataFrame(rows, "added_rows long, kind string")


_MS = "epoch_us(ts) // 1000"
for _name, _f, _sql in [
    ("lake_scoped", _scoped, f"SELECT event_type, COUNT(*) AS c, MIN({_MS}) AS lo, MAX({_MS}) AS hi FROM events WHERE user_id = 7 GROUP BY 1"),
    ("lake_pruned", _pruned, f"SELECT event_id, {_MS} AS ts FROM events WHERE user_id = 9 AND {_MS} BETWEEN 1704500000000 AND 1706000000000"),
    ("lake_column_kinds", _kinds, "SELECT event_id, value, value * 2 AS doubled, value / 2 AS half FROM events WHERE value / 2 > 10"),
    ("lake_compacted", _compacted, f"SELECT user_id, COUNT(*) AS c, MIN({_MS}) AS lo, MAX({_MS}) AS hi FROM events GROUP BY 1"),
    ("lake_deleted", _deleted, "SELECT user_id, COUNT(*) AS c FROM events WHERE user_id <> 7 GROUP BY 1"),
    ("lake_as_of", _as_of, "SELECT COUNT(*) AS c, MIN(event_id) AS lo FROM events WHERE event_id % 2 = 0"),
    ("lake_ingested", _ingested, "SELECT user_id, COUNT(*) AS c, ROUND(SUM(value * 2), 4) AS d FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0 GROUP BY 1"),
    ("lake_feed", _feed, "SELECT COUNT(*) AS added_rows, 'add' AS kind FROM events GROUP BY event_id % 3"),
]:
    QUERIES[_name], ORACLE_SQL[_name] = _f, _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
