"""Give the executors' Python workers this package."""

from __future__ import annotations

from pathlib import Path
from tempfile import mkdtemp
from zipfile import ZipFile

from pyspark.sql import SparkSession

import emberlog

DONE = "emberlog.llm.shipped"

#: Texts per Arrow batch: they may be long, and a batch is held in both processes.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session once; Spark hands them to each worker."""
    if spark.conf.get(DONE, None) is None:
        root = Path(emberlog.__file__).resolve().parent
        path = Path(mkdtemp(prefix="emberlog-")) / "emberlog-sources.zip"
        with ZipFile(path, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set(DONE, str(path))
    return spark
