"""Column expressions: deterministic Spark SQL, cast to the declared type."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.sources.schema import TYPES, SchemaError, TableColumns

# Functions that Catalyst counts as deterministic (or folds), but that differ from run to run,
# and those that reach outside the row.
DENIED = {
    "now", "current_date", "curdate", "current_timestamp", "current_time", "localtimestamp", "current_timezone", "current_user", "user",
    "session_user", "current_database", "current_catalog", "current_schema", "uuid", "rand", "random", "randn", "randstr", "uniform", "shuffle",
    "input_file_name", "input_file_block_start", "input_file_block_length", "monotonically_increasing_id", "spark_partition_id",
    "unix_timestamp", "java_method", "reflect", "try_reflect", "version",
}


def _analysed(spark: SparkSession, schema: StructType, sql: str) -> DataFrame:
    try:
        found = spark.createDataFrame([], schema).select(F.expr(sql))
        found.schema  # noqa: B018  forces analysis
    except Exception as e:
        raise SchemaError(f"expression {sql!r}: {str(e).splitlines()[0]}") from None
    return found


def _functions(spark: SparkSession, sql: str) -> set[str]:
    names, todo = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "UnresolvedFunction":
            names.add(node.nameParts().last().lower())
        elif node.getClass().getSimpleName() == "UnresolvedAttribute":  # some functions need no parentheses
            names.add(node.name().lower())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return names


def reject_volatile(spark: SparkSession, schema: StructType, sql: str) -> None:
    found = _analysed(spark, schema, sql)
    if denied := (_functions(spark, sql) & DENIED) - {n.lower() for n in schema.names}:
        raise SchemaError(f"expression {sql!r}: {', '.join(sorted(denied))} may differ from run to run")
    if not found._jdf.queryExecution().analyzed().deterministic():
        raise SchemaError(f"expression {sql!r} is not deterministic")


def compile(spark: SparkSession, schema: StructType, sql: str, type: str) -> SparkColumn:
    """A checked expression over `schema`, cast to the declared type."""
    reject_volatile(spark, schema, sql)
    return F.expr(sql).cast(TYPES[type])


def column_refs(spark: SparkSession, schema: StructType, sql: str) -> list[str]:
    """Sorted names of the columns that the expression reads."""
    used = _analysed(spark, schema, sql)._jdf.queryExecution().analyzed()
    refs = used.references().iterator()
    out = set()
    while refs.hasNext():
        out.add(refs.next().name())
    return sorted(out)


def validate(spark: SparkSession, columns: TableColumns) -> None:
    """Defaults and materialised columns over what is sent, aliases over what is stored."""
    for c in columns.columns:
        if c.kind in ("default", "materialized"):
            compile(spark, columns.input, c.expr, c.type)
        elif c.kind == "alias":
            compile(spark, columns.physical, c.expr, c.type)


def fill(df: DataFrame, columns: TableColumns) -> DataFrame:
    """Physical columns: defaults fill nulls, materialised columns are always computed, in declared order."""
    for c in columns.columns:
        if c.kind == "stored" and c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(None).cast(TYPES[c.type]))
        elif c.kind == "default":
            made = F.expr(c.expr).cast(TYPES[c.type])
            df = df.withColumn(c.name, F.coalesce(F.col(c.name), made) if c.name in df.columns else made)
        elif c.kind == "materialized":
            df = df.withColumn(c.name, F.expr(c.expr).cast(TYPES[c.type]))
    return df.select([F.col(f.name).alias(f.name, metadata=f.metadata) if f.metadata else F.col(f.name) for f in columns.physical])


def with_aliases(df: DataFrame, columns: TableColumns) -> DataFrame:
    """Query columns in declared order; aliases are computed at read."""
    out = []
    for c in columns.columns:
        value = F.expr(c.expr).cast(TYPES[c.type]) if c.kind == "alias" else F.col(c.name)
        out.append(value.alias(c.name, metadata=c.field.metadata) if c.field.metadata else value.alias(c.name))
    return df.select(out)
