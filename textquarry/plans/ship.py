"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to Python at most, unless the session has less.
BATCH_BYTES, _BATCH = 1 << 23, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds a zip of this package to the session's Python files, once for each Spark context."""
    bound_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_tq_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tq-ship-"), "textquarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)  # uploaded by the driver, fetched by each executor
    sc._tq_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python end at ``BATCH_BYTES`` (or after the row that passes it): their rows alone don't bound them, as texts differ in length."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
