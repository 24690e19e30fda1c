"""Scoring mappings against a gold standard."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..functions.text import bare_iri
from ..plans.sparql import generics


def judged(uses: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``query_id, gen_predicate, expected, predicted, correct, replaced``: the generics of
    each query that have gold. Not replaced, empty or other IRIs are incorrect."""
    rows = uses.select("query_id", "gen_predicate").distinct().join(gold, "gen_predicate")
    rows = rows.join(predicted.select("query_id", "gen_predicate", "predicted"), ["query_id", "gen_predicate"], "left")
    right = (bare_iri("predicted") == bare_iri("expected")) & (bare_iri("predicted") != "")
    return rows.select("query_id", "gen_predicate", "expected", "predicted", right.alias("correct"), (bare_iri("predicted") != "").alias("replaced"))


def per_query(rows: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy("query_id").agg(F.count("*").alias("total"), n("correct").alias("correct"), (F.count("*") - n("correct")).alias("incorrect"), n("replaced").alias("replaced"))


def summary(rows: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Totals and precision in percent (0 without rows); with ``query_id, seconds`` also
    mean time per query and per replaced predicate."""
    q = per_query(rows)
    q = q.join(timings, "query_id", "left") if timings is not None else q.withColumn("seconds", F.lit(None).cast("double"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = q.agg(F.count("*").alias("queries"), total("total").alias("predicates"), total("correct").alias("correct"), total("incorrect").alias("incorrect"), total("replaced").alias("replaced"), F.avg("seconds").alias("seconds_per_query"), F.avg(F.try_divide("seconds", F.nullif("replaced", F.lit(0)))).alias("seconds_per_predicate"))
    return out.withColumn("precision", F.coalesce(F.round(100 * F.try_divide("correct", F.col("correct") + F.col("incorrect")), 2), F.lit(0.0)))


def error_histogram(rows: DataFrame) -> DataFrame:
    wrong = rows.where("not correct").groupBy("gen_predicate").agg(F.count("*").alias("errors"))
    return wrong.orderBy(F.desc("errors"), "gen_predicate")


def timed_run(engine, queries: list[tuple[str, str]], gold: DataFrame, delay: float = 0.0) -> tuple[DataFrame, dict]:
    """Translates queries one after the other and judges what was chosen: a row for each
    query, and the summary. ``seconds`` is the time of a call; a pause between calls is not
    counted. A query that fails has no predictions and its error in the row."""
    rows, found, uses = [], [], []
    for k, (name, text) in enumerate(queries):
        if k and delay:
            time.sleep(delay)
        began, error, chosen = time.time(), None, {}
        try:
            chosen = engine.translate(text).mapping["selected"]
        except Exception as e:  # the run goes on
            error = f"{type(e).__name__}: {e}"
        rows.append((name, time.time() - began, error))
        uses += [(name, g) for g in generics(text)]
        found += [(name, g, v["predicate"]) for g, per in chosen.items() for v in per.values() if v["predicate"]]
    spark = engine.spark
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows_judged = judged(frame(uses, "query_id string, gen_predicate string"), gold, frame(found, "query_id string, gen_predicate string, predicted string"))
    seconds = frame(rows, "query_id string, seconds double, error string")
    report = seconds.join(per_query(rows_judged), "query_id", "left")
    return report, summary(rows_judged, seconds.select("query_id", "seconds")).first().asDict() | {"total_seconds": sum(r[1] for r in rows)}
