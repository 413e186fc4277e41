"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


_SHREDDING = (
    "writeShredding.enabled",
    "inferShreddingSchema",
    "allowReadingShredded",
    "pushVariantIntoScan",
)


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizing is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # of a key given twice in an object the last value counts
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # stored documents get a typed column per frequent key, and scans read only those used
    for name in _SHREDDING:
        spark.conf.set(f"spark.sql.variant.{name}", "true")
    return spark


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's progress below the session's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}"


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: until it does, the files of shuffles that no
    query uses any more stay on disk, also those of a long job's finished writes."""
    spark.sparkContext._jvm.System.gc()


def local_session(cpus: int | str = "*", app: str = "emberlog") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    parallelism = "8" if cpus == "*" else str(cpus)
    return configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
