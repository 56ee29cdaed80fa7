"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application id: its temporary folder


def folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.

    A temporary folder takes that folder's place on a local master only; on a cluster its absence is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        top = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spanlab-"))
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
