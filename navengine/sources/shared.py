"""The folder that all executors share, and small helpers around files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str = "nav") -> str:
    """A new folder's name under ``spark.checkpoint.dir``; only with a local master and none set, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.applicationId not in _OWN:
            _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="navengine-")
        base = _OWN[spark.sparkContext.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` as written to the shared folder and read again: computed once, and lost executors lose nothing."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is nothing."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def filesystem(uri: str):
    """(filesystem, path) of a URI through pyarrow, which executors can use without a session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def delete(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.delete_dir(path)
