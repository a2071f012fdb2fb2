"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. A local session without the setting (a
test, a notebook) gets a temporary folder of its own; on a cluster there is no
such folder that all could reach, so the setting is needed there. What a process
has written and not discarded is deleted when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lithomesh-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a whole URI, with the scheme and host of the default file system where it names none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    scheme, rest = uri.split(":", 1)
    return uri if rest.startswith("//") else f"{scheme}://{rest}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lithomesh/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    This cuts the lineage: later jobs, and retries after a lost executor, start
    from the files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lithomesh_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession | None = None) -> None:
    """Delete all tables that this process has written, when no result that is still to be read needs them."""
    for path, own in list(_written.items()):
        _delete(spark or own, path)
        del _written[path]


@atexit.register
def _sweep_at_exit() -> None:
    # the virtual machine may be gone already
    with contextlib.suppress(Exception):
        sweep()


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``materialise`` wrote, once no plan needs them."""
    for df in tables:
        path = getattr(df, "_lithomesh_path", None)
        if path in _written:
            _delete(df.sparkSession, path)
            del _written[path]


def release_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of ended jobs go.

    Spark deletes them when the driver collects its garbage, which may be long after;
    between the steps of an operator that shuffles much they would add up.
    """
    spark._jvm.System.gc()
