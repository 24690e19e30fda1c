"""Search over blocks of postings against a search over all of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille.operators import blocks as bl, index, search


def _built(spark, rows, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    names = [" ".join(r.choices(words, [1 / (i + 1) for i in range(30)], k=r.randint(1, 6))) for _ in range(rows)]
    docs = spark.createDataFrame([(f"e{i % 3 // 2}", f"r{i:05}", n) for i, n in enumerate(names)], "endpoint string, row_id string, text string")
    sizes = docs.groupBy("endpoint").agg(F.count("*").alias("size"))
    terms, postings = index.tfidf(index.term_counts(docs, longest=2), sizes)
    asked = [(f"gen:{' '.join(r.sample(words, r.randint(1, 3)))}",) for _ in range(25)]
    return sizes, terms.cache(), postings.cache(), search.query_terms(spark.createDataFrame(asked, "generic string"))


@pytest.mark.parametrize("k,rows", [(1, 4), (3, 16), (10, 128), (5000, 16)])
def test_same_rows_as_all_postings(spark, k, rows):
    sizes, terms, postings, queries = _built(spark, 2000, k)
    blocks = bl.posting_blocks(postings, sizes, rows).cache()
    got = sorted(map(tuple, bl.top_sparse(terms, blocks, queries, k).collect()))
    every = search.sparse_scores(terms, postings, queries).withColumn("score_sparse", F.round("score_sparse", search.DIGITS))
    want = search.top_k(every, k, "score_sparse", "row_id").select("generic", "endpoint", "rank", "row_id", "score_sparse")
    assert got == sorted(map(tuple, want.collect())) and got
    read = bl.reads(terms, blocks, queries, k).agg(F.sum("postings"), F.sum("postings_read")).first()
    assert read[0] == postings.join(search.query_weights(terms, queries), ["endpoint", "term"]).count()
    assert read[1] < 0.5 * read[0] if k <= 3 else read[1] <= read[0]


def test_blocks_hold_every_posting_once(spark):
    sizes, _, postings, _ = _built(spark, 500, 9)
    blocks = bl.posting_blocks(postings, sizes, 8)
    back = blocks.select("endpoint", "term", F.inline("rows"))
    assert sorted(map(tuple, back.select(*postings.columns).collect())) == sorted(map(tuple, postings.collect()))
    assert blocks.where("top <> array_max(rows.weight) or n <> size(rows)").count() == 0


def test_nothing_to_search(spark):
    sizes, terms, postings, queries = _built(spark, 50, 4)
    none = bl.posting_blocks(postings.limit(0), sizes)
    assert bl.top_sparse(terms, none, queries).count() == 0
    assert bl.top_sparse(terms, bl.posting_blocks(postings, sizes), queries.limit(0)).count() == 0


def test_nothing_of_the_size_of_an_index_is_broadcast(spark, tmp_path):
    """A table of few compressed bytes can have more rows than a driver holds."""
    path = str(tmp_path / "rows")
    spark.range(3000).selectExpr("concat('e', id % 3) endpoint", "concat('r', id) predicate", "'some name' local_name", "id usage_count").write.parquet(path)
    built = index.build_index(spark.read.parquet(path), accents=False)
    queries = search.query_terms(spark.createDataFrame([("gen:name",)], "generic string"), accents=False)
    sizes = built["meta"].groupBy("endpoint").agg(F.count("*").alias("size"))
    blocks = bl.posting_blocks(built["postings"], sizes)
    for df in (built["postings"], search.sparse_scores(built["terms"], built["postings"], queries), search.search(built, spark.createDataFrame([("gen:name",)], "generic string"), accents=False), bl.top_sparse(built["terms"], blocks, queries)):
        joins = re.findall(r"BroadcastHashJoin \[([^]]*)\]", df._jdf.queryExecution().executedPlan().toString())
        assert not [x for x in joins if re.search("endpoint#.*(term|row_id|range)#", x)]
