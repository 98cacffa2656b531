"""Files through Hadoop's file system API, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str, suffix: str = ".parquet") -> dict[str, tuple[int, float]]:
    """Files below a folder: path to bytes and time of change (seconds).  A missing folder has none."""
    p, fs = _at(spark, path)
    out: dict[str, tuple[int, float]] = {}
    if not fs.exists(p):
        return out
    found = fs.listFiles(p, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if name.endswith(suffix):
            out[name] = (f.getLen(), f.getModificationTime() / 1000)
    return out


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.delete(p, True))


def read_parts(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Exactly these files with this schema: columns that a file lacks are null; no files, no rows."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
