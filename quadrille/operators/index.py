"""TF-IDF index in long form: ``meta``, ``terms`` and ``postings`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import document_text, let, strip_accents, word_ngrams, words
from ..scratch import shuffled

MAX_FEATURES = 200_000
PARTS = 64


def term_counts(docs: DataFrame, text: str = "text", longest: int = 3, accents: bool = True, keys=("endpoint", "row_id")) -> DataFrame:
    """``*keys, term, tf``."""
    value = strip_accents(text) if accents else F.col(text)
    return docs.select(*keys, words(value).alias("_w")).select(*keys, F.inline(counted(word_ngrams(F.col("_w"), longest))))


def counted(grams: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms, within the row: runs of its sorted
    values. Arrays are bound once (``let``): inside a lambda an expression is evaluated for
    every element."""

    def runs(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == F.size(s)) | (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda f: F.transform(F.slice(f, 1, F.size(f) - 1), lambda at, k: F.struct(F.get(s, at).alias("term"), (F.get(f, k + 1) - at).cast("long").alias("tf"))))

    return let(F.sort_array(grams), lambda s: F.when(F.size(s) > 0, runs(s)))


def capped_terms(tf: DataFrame, limit: int | None) -> DataFrame:
    """Terms with ``df`` and total count, the ``limit`` most frequent of each endpoint
    (ties by term), or all. Ranked within ``PARTS`` parts first, so that one large endpoint's
    terms are not sorted in one task."""
    terms = tf.groupBy("endpoint", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    if limit is None:
        return terms
    order = (F.desc("n"), "term")
    for by in (["endpoint", F.pmod(F.xxhash64("term"), F.lit(PARTS))], ["endpoint"]):
        terms = terms.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= limit).drop("_r")
    return terms


def tfidf(tf: DataFrame, sizes: DataFrame, limit: int | None = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """``terms`` (idf = ln((1 + n) / (1 + df)) + 1) and ``postings`` with weights of unit
    length per row. ``sizes``: rows of each endpoint; ``limit``: of the terms of each, None for all."""
    terms = capped_terms(tf, limit).join(sizes, "endpoint").select("endpoint", "term", "df", "n", (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(shuffled(terms.select("endpoint", "term", "idf")), ["endpoint", "term"]).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("endpoint", "row_id")))
    return terms, raw.withColumn("weight", F.col("_w") / norm).select("endpoint", "row_id", "term", "weight")


def build_index(records: DataFrame, limit: int | None = MAX_FEATURES, accents: bool = True) -> dict[str, DataFrame]:
    """From ``endpoint, predicate, local_name, usage_count``; a row is an (endpoint,
    predicate)."""
    meta = records.groupBy("endpoint", "predicate").agg(F.max("local_name").alias("local_name"), F.sum("usage_count").alias("usage_count"))
    meta = meta.withColumns({"row_id": F.col("predicate"), "text": document_text("endpoint", "predicate", "local_name")})
    sizes = meta.groupBy("endpoint").agg(F.count("*").alias("size"))
    terms, postings = tfidf(term_counts(meta, accents=accents), sizes, limit)
    return {"meta": meta, "terms": terms, "postings": postings}
