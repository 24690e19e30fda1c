"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a folder of its own, a
    cluster's goes to the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quadrille"
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/quadrille/{tag}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle: Spark takes a table for small by its compressed files,
    though its rows may not fit the driver that would broadcast them."""
    return df.hint("merge")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: what several branches use is computed once, and a lost
    executor costs a re-read."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
