"""Delimited, text and columnar files, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder named in ``spark.checkpoint.dir``, else below the warehouse.

    Both are folders that all executors share; local and cluster sessions take the same path. The path is
    deleted when the session's JVM ends.
    """
    base = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    path = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/tabsight-{uuid.uuid4().hex}"
    _hadoop(spark, path, "deleteOnExit")
    return path


def _hadoop(spark: SparkSession, path: str, method: str, *more: object) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    getattr(fs, method)(target, *more)


def materialised(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written once and read back: later stages reuse it and lost executors do not recompute it.

    The shuffle files of the write are given up as soon as it has ended, where Spark can do so.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabsight_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialised`` that nothing will read any more."""
    for table in tables:
        _hadoop(table.sparkSession, table._tabsight_path, "delete", True)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """';' if the first line of the first file holds one, else ','."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and ";" in first[0]["value"] else ","


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a sniffed separator; header names are trimmed and lower-cased.

    With ``schema`` columns are found by their header names, in any order, and typed; a name that is missing or
    not in the schema is an error, also where a later file's header differs from the first one's. Without it every
    value stays text, as nothing is inferred.
    """
    sep = sniff_delimiter(spark, path)
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        df = reader.csv(path)
        return df.toDF(*[c.strip().lower() for c in df.columns])
    raw = reader.csv(path).columns
    names = [c.strip().lower() for c in raw]
    wanted = {f.name.strip().lower(): f for f in schema.fields}
    if sorted(names) != sorted(wanted):
        raise ValueError(f"header {names} does not match {sorted(wanted)}")
    typed = T.StructType([T.StructField(c, wanted[n].dataType) for c, n in zip(raw, names)])
    df = reader.option("enforceSchema", False).schema(typed).csv(path).toDF(*names)
    return df.select(*[F.col(n).alias(f.name) for n, f in wanted.items()])


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] = ()) -> None:
    """Parquet, JSON or CSV sink, optionally partitioned (by model and fold for predictions)."""
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """Integers from the lines that hold nothing but digits once trimmed."""
    t = F.trim("value")
    return spark.read.text(path).filter(t.rlike("^[0-9]+$")).select(t.cast("bigint").alias(name))
