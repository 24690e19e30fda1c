"""Writers. One-file outputs are asked for as such; tables stay partitioned."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions.text import local_name


def ranked(counts: DataFrame) -> DataFrame:
    """Count descending, then IRI descending."""
    return counts.select("usage_count", "predicate").orderBy(F.desc("usage_count"), F.desc("predicate"))


def write_frequencies(counts: DataFrame, path: str, single: bool = True) -> None:
    """``count <tab> <iri>``; a statistic has one row per predicate."""
    out = ranked(counts)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("sep", "\t").csv(path)


def write_ndjson(counts: DataFrame, path: str) -> None:
    iri = F.regexp_replace("predicate", "[<>]", "")
    ranked(counts).select(F.to_json(F.struct(iri.alias("iri"), "usage_count", local_name("predicate").alias("local_name"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def predicate_document(counts: DataFrame, endpoint: str) -> DataFrame:
    """One JSON document of an endpoint's predicates, ordered."""
    iri = F.regexp_replace("predicate", "[<>]", "")
    rows = F.struct((-F.col("usage_count")).alias("k"), iri.alias("iri"), "usage_count", local_name("predicate").alias("local_name"))
    listed = F.transform(F.array_sort(F.collect_list(rows)), lambda x: F.struct(x["iri"].alias("iri"), x["usage_count"].alias("usage_count"), x["local_name"].alias("local_name")))
    built = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct(F.lit(endpoint).alias("id"), F.lit(None).cast("string").alias("url"), built.alias("built_at"), F.lit(None).cast("long").alias("triples_sampled"), F.col("predicates"))
    return counts.agg(listed.alias("predicates")).select(F.to_json(F.struct(F.lit("1").alias("version"), F.array(one).alias("endpoints")), {"ignoreNullFields": "false"}).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def _built(spark, path: str) -> DataFrame | None:
    """``endpoint, build``: the build of each endpoint that counts."""
    try:
        return spark.read.schema("build string, endpoint string").parquet(f"{path}/built")
    except AnalysisException:
        return None


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """Tables of one or more endpoints. Each goes to a build of its own beside what is there,
    and a last, small table names the build of each endpoint that counts. A run that dies
    before it leaves the index as it was; other endpoints keep theirs. Builds that no
    longer count are deleted."""
    spark, build = next(iter(index.values())).sparkSession, uuid.uuid4().hex
    for name, df in index.items():
        df.withColumn("build", F.lit(build)).write.mode("append").partitionBy("endpoint", "build").parquet(f"{path}/{name}")
    own = [spark.read.parquet(f"{path}/{name}").where(F.col("build") == build).select("endpoint") for name, df in index.items()]
    done = reduce(DataFrame.unionByName, own).distinct().withColumn("build", F.lit(build))
    before = _built(spark, path)
    stale = [] if before is None else [(r["endpoint"], r["build"]) for r in before.join(done, "endpoint", "left_semi").collect()]  # a row an endpoint
    done.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("endpoint").parquet(f"{path}/built")
    for _, old in stale:
        for name in index:
            root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/endpoint=*/build={old}")
            system = root.getFileSystem(spark._jsc.hadoopConfiguration())
            for found in system.globStatus(root) or ():
                system.delete(found.getPath(), True)


def built_endpoints(spark, path: str) -> DataFrame:
    """``endpoint`` of those that have an index."""
    found = _built(spark, path)
    return spark.createDataFrame([], "endpoint string") if found is None else found.select("endpoint")


class MissingIndex(FileNotFoundError):
    """A folder without an index table, as parquet or CSV."""


def read_index(spark, path: str) -> dict[str, DataFrame]:
    """The tables of an index, ``vectors`` if it has them; ``meta`` also as CSV."""
    out = {}
    for name in ("meta", "terms", "postings", "vectors"):
        try:
            df = spark.read.parquet(f"{path}/{name}")
            built = _built(spark, path) if "build" in df.columns else None
            out[name] = df if built is None else df.join(F.broadcast(built), ["endpoint", "build"]).drop("build")  # a row an endpoint
        except AnalysisException:
            try:
                if name == "meta":
                    out[name] = spark.read.csv(f"{path}/{name}.csv", header=True, inferSchema=True)
            except AnalysisException:
                pass
            if name not in out and name != "vectors":
                raise MissingIndex(f"{path}/{name}") from None
    return out


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
