"""What Python workers need before a plan with Python in it runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


#: Bytes of an Arrow batch, whatever its rows.
BATCH_BYTES = 16 << 20


def prepare_workers(spark: SparkSession, batch_rows: int | None = None) -> None:
    """Bound the bytes, and perhaps the rows, of Arrow batches, and send this package to the executors once a session.

    The bounds are settings of the session; with rows of whole documents or files
    they bound the memory of a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if batch_rows is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    context = spark.sparkContext
    if context not in _shipped:
        folder = tempfile.mkdtemp(prefix="lithomesh-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).resolve().parent.parent
        context.addPyFile(shutil.make_archive(f"{folder}/lithomesh-code", "zip", package.parent, package.name))
        _shipped.add(context)


def bound_parser_caches(spark: SparkSession) -> None:
    """Bound what the SQL parser keeps of the expressions it has read, a setting of the session.

    Long expressions with nested functions leave some 25 MB in the driver for good, a
    heap several times as large between collections; reading the next takes a second more.
    """
    spark.conf.set("spark.sql.parser.manageParserCaches", "true")
    spark.conf.set("spark.sql.parser.parserDfaCacheFlushThreshold", "500")
