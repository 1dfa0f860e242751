"""Stored tables as versions, so that a change rewrites only the files that hold a row it concerns.

A version is a small table of the data files that make it up (folder, path). A change reads which files have a
hit (``_metadata.file_path``), rewrites these under a new folder and lists them with all other files
of the version before, which stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = "folder string, path string, rewritten boolean"


def _decoded(path: str) -> str:
    """A file name as readers take it (Spark reports names in URL encoding)."""
    return unquote(path)


def folder_version(spark: SparkSession, folder: str) -> DataFrame:
    """folder, path, rewritten of every data file of a table that was just written to ``folder``."""
    # The driver lists the files of any table it plans to read; no rows are read here.
    rows = [(folder, _decoded(p), False) for p in spark.read.parquet(folder).inputFiles()]
    return spark.createDataFrame(rows, FILES)


def read_version(spark: SparkSession, version: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of a version with the given columns (partition columns come from the files' folders)."""
    folders: dict[str, list[str]] = {}
    for r in version.collect():  # one row per data file, which the driver lists anyway
        folders.setdefault(r["folder"], []).append(r["path"])
    out = spark.createDataFrame([], schema)
    for folder, paths in sorted(folders.items()):
        out = out.unionByName(_read(spark, folder, sorted(paths), schema))
    return out


def _read(spark: SparkSession, folder: str, paths: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])


def files_with_hits(spark: SparkSession, version: DataFrame, schema: T.StructType, keys: DataFrame, key: str) -> DataFrame:
    """folder, path of the files of a version that hold a row whose ``key`` is among ``keys``."""
    ids = keys.select(key).distinct()
    hits = None
    folders: dict[str, list[str]] = {}
    for r in version.collect():
        folders.setdefault(r["folder"], []).append(r["path"])
    for folder, paths in sorted(folders.items()):
        stored = spark.read.schema(schema).option("basePath", folder).parquet(*sorted(paths))
        found = stored.select(F.col(key), stored.metadataColumn("_metadata")["file_path"].alias("_file")).join(ids, key, "left_semi").select(
            F.lit(folder).alias("folder"), F.col("_file").alias("path")).distinct()
        hits = found if hits is None else hits.unionByName(found)
    rows = [] if hits is None else [(r["folder"], _decoded(r["path"])) for r in hits.collect()]  # a subset of the version's files
    known = {(_plain(r["path"])): (r["folder"], r["path"]) for r in version.collect()}
    return spark.createDataFrame([known[_plain(p)] for _, p in rows], "folder string, path string")


def _plain(path: str) -> str:
    """A path without the differences in which Spark names one local or remote file."""
    scheme, sep, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if sep and "/" not in scheme else f"file:/{path.lstrip('/')}"


def rewrite_hits(spark: SparkSession, version: DataFrame, schema: T.StructType, keys: DataFrame, key: str,
                 change: Callable[[DataFrame], DataFrame], out: str, partition_by: list[str] | None = None) -> DataFrame:
    """The version after ``change`` of the rows whose ``key`` is among ``keys``.

    ``change`` gets all rows of the files with a hit and must return them with the same columns; the result is written to
    ``out`` (as many files as were hit). Nothing is written where no file has a hit.
    """
    hits = files_with_hits(spark, version, schema, keys, key)
    gone = {(r["folder"], r["path"]) for r in hits.collect()}
    kept = [(r["folder"], r["path"], False) for r in version.collect() if (r["folder"], r["path"]) not in gone]
    if not gone:
        return spark.createDataFrame(kept, FILES)
    after = change(read_version(spark, hits, schema)).select(*[F.col(f"`{c}`") for c in schema.names])
    writer = after.coalesce(len(gone)).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    new = [(out, _decoded(p), True) for p in spark.read.parquet(out).inputFiles()]
    return spark.createDataFrame(kept + new, FILES)
