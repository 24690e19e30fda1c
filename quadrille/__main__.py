"""Command lines: ``python -m quadrille COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from .engine import Engine, Settings
from .operators import index, stats
from .operators.evaluation import timed_run
from .sources import catalog, rdf, sinks


def count(spark, a) -> None:
    """Predicate frequencies of a folder of dumps, as TSV, lines of JSON and a document."""
    counts = stats.predicate_counts(rdf.predicates(spark, a.path, a.mode))
    sinks.write_frequencies(counts, f"{a.out}/predicates.freq.tsv")
    sinks.write_ndjson(counts, f"{a.out}/predicates.ndjson")
    sinks.predicate_document(counts, a.endpoint).coalesce(1).write.mode("overwrite").text(f"{a.out}/predicates.json")


def convert_n3(spark, a) -> None:
    """N3 to N-Triples; what cannot be read goes beside it. A dry run shows repaired lines."""
    if a.dry_run:
        rdf.read_n3_lines(spark, a.path, dry_run=True).show(1000, truncate=False)
        return
    rdf.convert_n3(spark, a.path, a.out).write.mode("overwrite").json(a.out + "-failures")


def build_index(spark, a) -> None:
    """The index of the predicate documents below a folder, a sub-folder an endpoint. An
    endpoint that is named is built anew; without a name those that have no index are."""
    names = [a.endpoint] if a.endpoint else catalog.discover_endpoints(spark, a.path)
    found = spark.createDataFrame([(n,) for n in names], "endpoint string")
    left = found if a.endpoint or a.rebuild else catalog.not_built(found, sinks.built_endpoints(spark, a.out))
    for name in sorted(r["endpoint"] for r in left.collect()):  # a row an endpoint
        sinks.write_index(index.build_index(catalog.predicate_records(spark, f"{a.path}/{name}", name), a.max_features), a.out)


def _engine(spark, a) -> Engine:
    urls = {r["id"]: r["url"] for r in catalog.read_endpoints(spark, a.endpoints).collect()}  # a row an endpoint
    return Engine(spark, sinks.read_index(spark, a.index), urls, settings=Settings(top_k=a.top_k, popularity=a.popularity))


def translate(spark, a) -> None:
    """Every query of a folder: its text rewritten, as lines of JSON."""
    _engine(spark, a).translate_batch(catalog.read_queries(spark, a.path)).write.mode("overwrite").json(a.out)


def evaluate(spark, a) -> None:
    """Queries one by one, timed, against a gold mapping; prints the summary."""
    queries = [(r["query_id"], r["text"]) for r in catalog.read_queries(spark, a.path).orderBy("query_id").collect()]  # a row a file
    report, summary = timed_run(_engine(spark, a), queries, catalog.read_gold(spark, a.gold), a.delay)
    sinks.write_report(report, a.out)
    print(json.dumps(summary))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(f, *more):
        p = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        p.add_argument("path")
        p.add_argument("--out", required=f is not convert_n3)
        for name, options in more:
            p.add_argument(name, **options)

    engine = [("--index", {"required": True}), ("--endpoints", {"required": True}), ("--top-k", {"type": int, "default": 3}), ("--popularity", {"type": float, "default": 0.0})]
    command(count, ("--endpoint", {"default": ""}), ("--mode", {"choices": rdf.MODES, "default": rdf.MODES[0]}))
    command(convert_n3, ("--dry-run", {"action": "store_true"}))
    command(build_index, ("--endpoint", {}), ("--rebuild", {"action": "store_true"}), ("--max-features", {"type": int, "default": index.MAX_FEATURES}))
    command(translate, *engine)
    command(evaluate, *engine, ("--gold", {"required": True}), ("--delay", {"type": float, "default": 1.0}))
    a = top.parse_args(argv)
    a.run(spark or SparkSession.builder.appName("quadrille").getOrCreate(), a)


if __name__ == "__main__":
    main()
