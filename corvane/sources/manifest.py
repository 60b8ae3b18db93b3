"""One manifest for several tables: their new versions become current together, or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Stale(RuntimeError):
    """Another writer has committed since the version that a commit builds on."""


def _file(spark: SparkSession, root: str, version: int | None = None):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest" + ("" if version is None else f"/{version:012d}.json"))
    return path.getFileSystem(conf), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions in order; names of files that a writer left half written are passed over."""
    fs, path = _file(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version, tables (name: folders) and facts of a version, the current one unless it is named; version -1 is the empty one."""
    known = versions(spark, root)
    version = (known[-1] if known else -1) if version is None else version
    if version < 0:
        return {"version": -1, "tables": {}, "facts": {}}
    if version not in known:
        raise ValueError(f"{root} has no version {version}")
    fs, path = _file(spark, root, version)
    return json.loads(spark.read.option("wholetext", "true").text(path.toString()).first()["value"])


def write(df: DataFrame, root: str, name: str, partition: list[str] | None = None) -> str:
    """Writes ``df`` to a new folder of the table ``name`` and returns the folder; no reader sees it before a commit names it."""
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition or [])).parquet(path)
    return path


def commit(spark: SparkSession, root: str, base: dict, tables: dict[str, list[str]], facts: dict | None = None) -> dict:
    """Makes a new version current: ``base`` with the folders of ``tables`` in place of its own. Tables that are not named stay.

    The version is written whole under another name and then renamed to its number, which fails where a writer was
    faster: then ``Stale`` is raised, nothing is current that was not, and the writer has to build on the newer version.
    Readers take the file of the highest number, so they see all tables of a commit or none. Where many drivers write, the folder
    has to be on a file system whose rename is atomic and doesn't replace, such as HDFS; a local one is for one driver.
    """
    new = {"version": base["version"] + 1, "tables": base["tables"] | tables, "facts": base["facts"] | (facts or {})}
    if versions(spark, root)[-1:] not in ([], [base["version"]]):
        raise Stale(f"{root} has a version after {base['version']}")
    fs, path = _file(spark, root, new["version"])
    draft = path.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, path, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Stale(f"{root} has a version after {base['version']}") from None
        raise
    return new


def table(spark: SparkSession, state: dict, name: str, schema: str, folders: list[str] | None = None) -> DataFrame:
    """The table ``name`` of a version as ``read`` returned it: the rows of all its folders, none if it has no folder."""
    folders = state["tables"].get(name, []) if folders is None else folders
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
