"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_MADE: list[str] = []  # folders that this driver named, oldest first


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder.

    The shared folder is the session's ``spark.checkpoint.dir``; only where
    that is unset (tests on one machine) a temporary folder stands in for it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="navengine-")
        base = _OWN_DIRS[app]
    _MADE.append(f"{base.rstrip('/')}/navengine-{uuid.uuid4().hex}")
    return _MADE[-1]


def mark() -> int:
    """How many folders were named so far, for ``clear``."""
    return len(_MADE)


def clear(since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the folders named since a mark, but for those that ``keep`` reads; how many went.

    What operators return reads such folders, so this is for what has been written elsewhere or is not needed any more.
    """
    used = [f.split("/navengine-")[1].split("/")[0] for f in keep.inputFiles() if "/navengine-" in f] if keep is not None else []
    gone, left = 0, []
    for uri in _MADE[since:]:
        if uri.rsplit("/navengine-", 1)[1] in used:
            left.append(uri)
            continue
        fs, path = filesystem(uri)
        try:
            fs.delete_dir(path)
            gone += 1
        except FileNotFoundError:
            pass  # named, but nothing was written
    _MADE[since:] = left
    return gone


def materialize(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again; by so many tasks at most, where its size is known.

    This cuts lineage in a way that survives lost executors: whoever needs the
    rows reads files that every node sees.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    (df if tasks is None else df.coalesce(tasks)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """``(filesystem, path)`` of a URI through pyarrow (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
