"""Namespace sessions and the read-only SQL gate."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import with_aliases
from spindrift.operators.catalog import Catalog, CatalogError, Hypertable, NotFound
from spindrift.operators.pruning import ColumnRange, bounds, bounds_of
from spindrift.sources import files
from spindrift.sources.schema import type_name

FORMATS = ("columns", "rows", "arrow")


class QueryError(Exception):
    status, retryable = 400, False


class Refused(QueryError):
    """Not a read-only query over the namespace's tables."""


class Timeout(QueryError):
    status = 408


class Unavailable(QueryError):
    status, retryable = 503, True


class Internal(QueryError):
    status = 500


# Plan nodes of queries.  Anything else, at any depth, is refused.
_QUERIES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset",
    "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
}
# Functions that reach outside the session's tables.
_DENIED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files", "python_udtf", "current_catalog", "read_kafka", "read_state", "read_statestore", "identifier"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
# Names that callers use for functions Spark has under other names.
_FUNCTIONS = {"to_timestamp_seconds(s BIGINT) RETURNS TIMESTAMP": "timestamp_seconds(s)", "to_timestamp_millis(ms BIGINT) RETURNS TIMESTAMP": "timestamp_millis(ms)", "from_unixtime_seconds(s BIGINT) RETURNS TIMESTAMP": "timestamp_seconds(s)"}
_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\binformation_schema\s*\.\s*(tables|columns)\b", re.I | re.S)


def table(spark: SparkSession, catalog: Catalog, ht: Hypertable, key: int | None, ranges: Sequence[ColumnRange] = (), as_of: int | None = None) -> DataFrame:
    """Query columns of a hypertable from the parts that may matter; `key` restricts it to one packing key.

    The files are fixed here.  The key filter stays whatever was pruned, below everything a user writes.
    """
    parts = catalog.live_parts(ht.id, key, ranges, as_of=as_of)
    df = files.read_parts(spark, [p.path for p in parts], ht.columns.physical)
    if key is not None:
        df = df.where(F.col(ht.packing_key) == F.lit(key))
    return with_aliases(df, ht.columns)


@dataclass
class Result:
    df: DataFrame
    schema: list[dict]

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def columns(self) -> dict[str, list]:
        """Column-wise values; types beyond the core ones as text."""
        t = self.df.toArrow()
        core = {"int64", "timestamp_ms", "float64", "utf8", "bool"}
        plain = {c["name"]: c["type"] in core for c in self.schema}
        return {n: [v if v is None or plain[n] else str(v) for v in t[k].to_pylist()] for k, n in enumerate(t.column_names)}

    def arrow(self) -> bytes:
        import pyarrow as pa

        t, sink = self.df.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()


def schema_block(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": type_name(f), "nullable": f.nullable} for f in df.schema]


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


# Expressions that hold a plan.
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


def _expressions(plan):
    """All expressions of one plan node, at any depth."""
    todo = _items(plan.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _items(e.children())


class Namespace:
    """A session that sees the tables of one namespace, and of each only its own rows.

    `namespace=None` is the operator's session: every hypertable under its own name, whole.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, namespace: int | None, ranges: dict[str, Sequence[ColumnRange]] | None = None, as_of: int | None = None):
        self.namespace, self.spark = namespace, spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        found = catalog.logical_tables(namespace) if namespace is not None else [(h.name, h) for h in catalog.hypertables()]
        self.tables = dict(found)
        self.catalog, self.ranges, self.as_of = catalog, ranges or {}, as_of
        for name in self.tables:
            self._view(name, self.ranges.get(name, ()))
        for signature, body in _FUNCTIONS.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        self._information()

    def _view(self, name: str, ranges: Sequence[ColumnRange]) -> None:
        table(self.spark, self.catalog, self.tables[name], self.namespace, ranges, self.as_of).createOrReplaceTempView(name)

    def _information(self) -> None:
        tables = [("spindrift", "public", n, "BASE TABLE") for n in self.tables]
        columns = [("spindrift", "public", n, f.name, k + 1, "YES" if f.nullable else "NO", type_name(f)) for n, h in self.tables.items() for k, f in enumerate(h.columns.query)]
        self.spark.createDataFrame(tables, "table_catalog string, table_schema string, table_name string, table_type string").createOrReplaceTempView("information_schema_tables")
        self.spark.createDataFrame(columns, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string").createOrReplaceTempView("information_schema_columns")

    def check(self, sql: str):
        """The parsed statement; refused is whatever is not a query over this session's tables, before Spark
        would run it.  Every plan node and expression is looked at, those of subqueries too."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise Refused(str(e).strip().splitlines()[0]) from None
        self._check(plan, {*(n.lower() for n in self.tables), "information_schema_tables", "information_schema_columns"})
        return plan

    def _check(self, plan, names: set[str]) -> None:
        kind = _kind(plan)
        if kind not in _QUERIES:
            raise Refused(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            # A CTE sees those before it, and itself only if it is recursive.
            for cte in _items(plan.cteRelations()):
                name = cte._1().lower()
                self._check(cte._2(), names | {name} if plan.allowRecursion() else names)
                names = names | {name}
        elif kind == "UnresolvedRelation":
            found = _items(plan.multipartIdentifier())
            if len(found) != 1 or found[0].lower() not in names:
                raise Refused(f"only the namespace's tables can be read, not {'.'.join(found)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(plan.name()))
            if name.lower() not in _TABLE_FUNCTIONS:
                raise Refused(f"table function {name} is not allowed")
        for e in _expressions(plan):
            if _kind(e) == "UnresolvedFunction":
                parts = _items(e.nameParts())
                if len(parts) != 1 or parts[0].lower() in _DENIED:
                    raise Refused(f"function {'.'.join(parts)} is not allowed")
            elif _kind(e) == "UnresolvedGenerator" and e.name().funcName().lower() not in _TABLE_FUNCTIONS:
                raise Refused(f"function {e.name().funcName()} is not allowed")
            elif "Identifier" in _kind(e):
                raise Refused("names are written out, not computed")
            if _kind(e) in _SUBQUERIES:
                self._check(e.plan(), names)
            elif "Subquery" in _kind(e) and _kind(e) != "InSubquery":
                raise Refused(f"{_kind(e)} is not allowed")
        for child in _items(plan.children()):
            self._check(child, names)

    def _pruned(self, plan) -> dict[str, list[ColumnRange]]:
        """Bounds that the statement's own filters put on tables that it names once."""
        named, filtered, todo = [], {}, [plan]
        while todo:
            node = todo.pop()
            if _kind(node) == "UnresolvedRelation":
                named.append(_items(node.multipartIdentifier())[-1].lower())
            if _kind(node) == "UnresolvedWith":
                todo += [cte._2() for cte in _items(node.cteRelations())]
            if _kind(node) == "Filter":
                below, alias = node.child(), None
                if _kind(below) == "SubqueryAlias":
                    below, alias = below.child(), below.alias()
                if _kind(below) == "UnresolvedRelation":
                    name = _items(below.multipartIdentifier())[-1].lower()
                    filtered[name] = (node.condition(), alias or name)
            todo += _items(node.children()) + [e.plan() for e in _expressions(node) if _kind(e) in _SUBQUERIES]
        out = {}
        for name, ht in self.tables.items():
            if named.count(name.lower()) == 1 and name.lower() in filtered:
                condition, alias = filtered[name.lower()]
                ints = [f.name for f in ht.columns.physical if f.dataType.simpleString() == "bigint"]
                if found := bounds_of(condition, ints, alias):
                    out[name] = found
        return out

    def sql(self, sql: str) -> DataFrame:
        sql = _QUOTED.sub(lambda m: m[1] or f"information_schema_{m[2].lower()}", sql)
        pruned = self._pruned(self.check(sql))
        try:
            for name, ranges in pruned.items():
                self._view(name, [*self.ranges.get(name, ()), *ranges])
            return self.spark.sql(sql)
        except Exception as e:
            raise QueryError(str(e).strip().splitlines()[0]) from None
        finally:
            for name in pruned:  # a view is resolved when the statement is
                self._view(name, self.ranges.get(name, ()))


@dataclass(frozen=True)
class Limits:
    statement_timeout: float = 300.0
    admission_timeout: float = 1.0


def query_class(sql: str) -> str:
    """A label for metrics: introspection, aggregate or select."""
    low = sql.lower()
    if "information_schema" in low:
        return "introspection"
    return "aggregate" if re.search(r"\bgroup\s+by\b|\b(count|sum|avg|min|max)\s*\(", low) else "select"


def accept_format(field: str | None, accept: str | None) -> str:
    """The request's own field goes before its Accept header, and that before the default."""
    if field is not None:
        if field not in FORMATS:
            raise QueryError(f"format {field!r} is not one of {', '.join(FORMATS)}")
        return field
    return "arrow" if "application/vnd.apache.arrow.stream" in (accept or "") else "columns"


def query(spark: SparkSession, catalog: Catalog, namespace: int, sql: str, format: str | None = None, accept: str | None = None, limits: Limits = Limits(), where: str | None = None) -> dict:
    """Run one statement for a namespace: {"schema", and "columns", "rows" or "arrow"}.

    Admission (catalog and planning) and the whole statement are limited in time; a statement over it is
    cancelled.  `where`, a predicate that the caller also states in `sql`, prunes parts by its bounds.
    """
    form = accept_format(format, accept)
    tag, box = f"query-{uuid.uuid4().hex}", {}
    admitted = threading.Event()

    def run() -> None:
        try:
            session = Namespace(spark, catalog, namespace)
            if where:
                ints = {n: [f.name for f in h.columns.physical if f.dataType.simpleString() == "bigint"] for n, h in session.tables.items()}
                session = Namespace(spark, catalog, namespace, {n: bounds(spark, where, c) for n, c in ints.items()})
            df = session.sql(sql)
            admitted.set()
            session.spark.sparkContext.addJobTag(tag)
            result = Result(df, schema_block(df))
            box["out"] = {"schema": result.schema, form: getattr(result, form)()}
        except Exception as e:
            box["error"] = e
        finally:
            admitted.set()

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    if not admitted.wait(max(limits.admission_timeout, 0)):
        raise Unavailable("the catalog did not answer in time")
    worker.join(limits.statement_timeout)
    if worker.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        raise Timeout(f"the statement took more than {limits.statement_timeout} s")
    if (error := box.get("error")) is None:
        return box["out"]
    if isinstance(error, QueryError):
        raise error
    if isinstance(error, NotFound):
        raise QueryError(str(error))
    if isinstance(error, CatalogError):
        raise Unavailable(str(error))
    raise Internal(str(error).splitlines()[0]) from error
