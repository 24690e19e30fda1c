"""Predicate counts over a folder that dumps are dropped into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.rdf import fields


def predicate_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """``predicate, usage_count`` so far; state is one row per predicate. Write it in
    ``update`` or ``complete`` mode."""
    lines = spark.readStream.option("pathGlobFilter", "*.{nt,nt.gz}").option("maxFilesPerTrigger", files_per_trigger).text(path)
    f = lines.select(fields(F.col("value")).alias("f")).where((F.size("f") >= 3) & ~F.col("f")[0].startswith("#") & F.col("f")[1].startswith("<"))
    return f.groupBy(F.col("f")[1].alias("predicate")).agg(F.count("*").alias("usage_count"))
