"""Predicate statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Tables mapped directly to triples: key columns and the columns that become predicates,
#: which are all others but vectors.
DIRECT = {
    "region": (["r_regionkey"], ["r_name"]),
    "nation": (["n_nationkey"], ["n_name", "n_regionkey"]),
    "customer": (["c_custkey"], ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "supplier": (["s_suppkey"], ["s_name", "s_nationkey", "s_acctbal"]),
    "part": (["p_partkey"], ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": (["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": (["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
    "events": (["event_id"], ["ts", "user_id", "event_type", "value", "props"]),
    "documents": (["doc_id"], ["text", "lang", "source", "n_chars"]),
    "embeddings": (["vec_id"], ["label"]),
    "pages": (["page_id"], ["url", "html"]),
    "benchmark": (["item_id"], ["text"]),
    "labels": (["doc_id"], ["quality", "toxic"]),
    "conversations": (["conv_id", "turn"], ["role", "text"]),
}
#: Foreign keys become IRIs of the table they point to.
LINKS = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_partkey": "part", "l_suppkey": "supplier"}


def direct_triples(spark: SparkSession, sf_dir: str, tables=tuple(DIRECT), by_predicate: bool = False, only: set[str] | None = None) -> DataFrame:
    """``endpoint, s, p, o`` of table rows: a triple per non-null mapped column.

    One scan gives all triples of a table; with ``by_predicate`` each column is a branch
    with its predicate as a constant, so that a query which names predicates reads only
    their columns; ``only`` names those there shall be branches for."""
    value = lambda c: F.concat(F.lit(f"ex:{LINKS[c]}/"), F.col(c)) if c in LINKS else F.col(c).cast("string")
    parts = []
    for t in tables:
        keys, cols = DIRECT[t]
        cols = [c for c in cols if only is None or f"ex:{t}#{c}" in only]
        if not cols:
            continue
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        s, at = F.concat(F.lit(f"ex:{t}/"), F.concat_ws("-", *keys)).alias("s"), F.lit(t).alias("endpoint")
        if by_predicate:
            parts += [df.where(F.col(c).isNotNull()).select(at, s, F.lit(f"ex:{t}#{c}").alias("p"), value(c).alias("o")) for c in cols]
        else:
            pairs = F.array(*[F.struct(F.lit(f"ex:{t}#{c}").alias("p"), value(c).alias("o")) for c in cols])
            parts.append(df.select(at, s, F.inline(pairs)).where("o is not null"))
    return reduce(DataFrame.unionByName, parts)


def predicate_counts(uses: DataFrame, *by: str) -> DataFrame:
    """``*by, predicate, usage_count``: bag semantics, a partial count per task."""
    return uses.groupBy(*by, F.col("p").alias("predicate")).agg(F.count("*").alias("usage_count"))


def distinct_predicate_counts(triples: DataFrame, *by: str) -> DataFrame:
    """Set semantics: each triple counts once."""
    return predicate_counts(triples.select(*by, "s", "p", "o").distinct(), *by)


def merged_counts(counts: DataFrame, *by: str) -> DataFrame:
    """Per-file counts summed."""
    return counts.groupBy(*by, "predicate").agg(F.sum("usage_count").alias("usage_count"))


def most_common(uses: DataFrame, key: str, position: str) -> DataFrame:
    """``key, n, place`` by count descending, ties by first use. Counts of the keys, one row
    each, are ranked in one task."""
    counts = uses.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def predicate_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.countDistinct("predicate").alias("n_predicates"), F.sum("usage_count").alias("n_statements"))
