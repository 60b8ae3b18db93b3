"""Versioned snapshots of tables: every version is a folder of its own, and a small file names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, root: str, name: str, version: int, partition: list[str] | None = None) -> str:
    """Write ``df`` as a version of a table; a version that exists is never touched."""
    path = f"{root}/{name}/v{version}"
    df.write.mode("errorifexists").partitionBy(*(partition or [])).parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/{name}/_log")
    return path


def current(spark: SparkSession, root: str, name: str) -> int:
    return spark.read.schema("version long").json(f"{root}/{name}/_log").agg({"version": "max"}).first()[0]


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/v{version if version is not None else current(spark, root, name)}")


def replaced(old: DataFrame, new: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``old`` with the rows of the keys in ``new`` replaced and those in ``removed`` left out: an upsert without MERGE."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_calls(calls: DataFrame, path: str, args: str = "args", width: int = 500) -> None:
    """Add calls to the telemetry, their arguments cut to ``width`` characters."""
    calls.withColumn(args, F.substring(args, 1, width)).write.mode("append").parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Empty tables, keeping their schemas; all others stay as they are."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
