"""Bulk loads: Parquet files, and JSON lines mapped to flat rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import fill
from spindrift.operators.catalog import Catalog, Hypertable
from spindrift.operators.writer import write


def key_of_text(column: Column | str) -> Column:
    """A non-negative packing key for a text; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNotNull(), F.xxhash64(column).bitwiseAND(F.lit((1 << 63) - 1)))


def json_rows(spark: SparkSession, path: str | list[str], fields: Mapping[str, tuple[str, str]], required: Iterable[str] = ()) -> DataFrame:
    """Rows of JSON lines (plain or gzip): `fields` has a JSON path and a type for each column.

    What a line lacks or has in another type is null; lines without a `required` value are left out, and so
    are those that are not JSON if anything is required.
    """
    lines = spark.read.text(path)
    rows = lines.select(*(F.get_json_object("value", at).try_cast(kind).alias(name) for name, (at, kind) in fields.items()))
    return rows.dropna(subset=list(required)) if required else rows


def load_parquet(spark: SparkSession, catalog: Catalog, ht: Hypertable, root: str, paths: Iterable[str], partitions: Mapping[str, Column], level: int = 1, rename: Mapping[str, str] | None = None) -> list:
    """Load files into a hypertable, one commit a file, and return what the catalog gave for each.

    Columns are taken by name (after `rename`, from name in the file to name in the table) and cast to the
    declared types; others are ignored.  `partitions` has an expression for each partition column.
    """
    commits = []
    for path in paths:
        df = spark.read.parquet(path).withColumnsRenamed(dict(rename or {}))
        rows = fill(df, ht.columns).withColumns(dict(partitions))
        commits.append(catalog.commit(ht.id, write(spark, catalog, ht, root, rows, level)))
    return commits
