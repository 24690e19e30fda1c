"""Queries as rows: ``query_id, text`` in, patterns or rewritten texts out, in Arrow passes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..plans.rewrite import normalise_mapping, rewrite_tree
from ..plans.sparql import Group, Optional_, Service, Triple, Union_, generic_triples, generics, parse, show

PATTERNS = "query_id string, block string, pos int, s string, p string, o string, error string"
REWRITTEN = "query_id string, n_generics int, n_triples int, rewritten string, error string"


def blocks(g: Group, path: str = "") -> Iterator[tuple[str, Triple]]:
    """Patterns in the order of the text, each with the path of its group: the place of
    every group in the one around it, branches of a union numbered after a point."""
    for i, x in enumerate(g.items):
        if isinstance(x, Triple):
            yield path, x
        elif isinstance(x, Optional_ | Service):
            yield from blocks(x.group, f"{path}/{i}")
        elif isinstance(x, Group):
            yield from blocks(x, f"{path}/{i}")
        elif isinstance(x, Union_):
            for j, y in enumerate(x.groups):
                yield from blocks(y, f"{path}/{i}.{j}")


def _rows(queries: DataFrame, of, schema: str) -> DataFrame:
    """``of(text)`` gives rows; what it raises becomes a row with an error."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for query_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [{"query_id": query_id, **r} for r in of(text or "")]
                except Exception as e:  # whatever is wrong with one query, the others are read
                    out.append({"query_id": query_id, "error": f"{type(e).__name__}: {e}"[:500]})
            kinds = [pa.int32() if " int" in x else pa.string() for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)], names)

    texts, slots = queries.select(F.col("query_id").cast("string").alias("query_id"), "text"), queries.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < slots:  # a file of few bytes is one task, however many texts it has
        texts = texts.repartition(slots)
    return texts.mapInArrow(run, schema)


def query_patterns(queries: DataFrame) -> DataFrame:
    """``query_id, block, pos, s, p, o, error``: a row a triple pattern; a row with an error
    for a query that cannot be parsed."""
    return _rows(queries, lambda text: [{"block": b, "pos": i, "s": t.s, "p": t.p, "o": t.o} for i, (b, t) in enumerate(blocks(parse(text).where))], PATTERNS)


def service_blocks(patterns: DataFrame, chosen: DataFrame) -> DataFrame:
    """``query_id, block, endpoint, pos, n_patterns, body``: what is sent to each endpoint.
    ``chosen`` has ``generic, endpoint, predicate``; patterns of one block and endpoint go
    together, at the place of the first, in their order."""
    met = patterns.where("error is null").join(chosen.select(F.col("generic").alias("p"), "endpoint", "predicate"), "p")
    line = lambda x: F.concat_ws(" ", x["s"], x["p"], x["o"], F.lit("."))
    lines = F.array_sort(F.collect_list(F.struct("pos", "s", F.col("predicate").alias("p"), "o")))
    out = met.groupBy("query_id", "block", "endpoint").agg(F.min("pos").alias("pos"), F.count("*").alias("n_patterns"), lines.alias("_l"))
    return out.select("query_id", "block", "endpoint", "pos", "n_patterns", F.array_join(F.transform("_l", line), "\n").alias("body"))


def rewritten(queries: DataFrame, chosen: dict, urls: dict[str, str]) -> DataFrame:
    """``query_id, n_generics, n_triples, rewritten, error`` of every query under one mapping;
    the mapping, a row a placeholder, goes with the tasks."""

    mapping = normalise_mapping(chosen)

    def of(text):
        q = parse(text)
        yield {"n_generics": len(generics(text)), "n_triples": len(generic_triples(q)), "rewritten": show(rewrite_tree(q, mapping, urls))}

    return _rows(queries, of, REWRITTEN)
