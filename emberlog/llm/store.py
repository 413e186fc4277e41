"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a single machine a folder made once per session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    made = spark.conf.get("emberlog.llm.folder", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        made = f"file://{mkdtemp(prefix='emberlog-')}"
        spark.conf.set("emberlog.llm.folder", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/emberlog-llm/{uuid4()}/{name}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: cuts lineage, survives lost executors.

    Parquet rather than ``checkpoint()``: columns are compressed and pruned, and the
    size is known to the planner, which decides by it whether to broadcast.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
