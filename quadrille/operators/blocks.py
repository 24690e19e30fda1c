"""Postings in blocks of like weight, and a top-k search that skips blocks which cannot
reach it.

The rows of an endpoint are dealt by a hash into ranges of about ``RANGE`` rows, the same
for all terms; a term's postings in a range are cut into bands of weight. Such a block's
head holds its largest weight. Nothing is sorted, and a frequent term is spread over tasks.

A search reads heads first. What the terms of a placeholder can add up to in a range bounds
the scores of its rows; the ranges of the highest bounds are scored, and their k-th best
score is a floor under the k-th best of all. Then a block is read only where its largest
weight, with the most that the other terms can add in that range, reaches the floor. A row
among the best k has all its postings in such blocks, so its score and place are those of
a search over all postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .search import DIGITS, TOP_K, query_weights
from ..scratch import shuffled, stored

#: Rows of a range, about; bands of weight between 0 and 1.
RANGE, BANDS = 256, 16
_PLACE = ["endpoint", "range"]
_AT = ["endpoint", "term", "range", "band"]
_ASKED = ["generic", "endpoint"]


def posting_blocks(postings: DataFrame, sizes: DataFrame, rows: int = RANGE) -> DataFrame:
    """``endpoint, term, range, band, top, n, rows`` of ``endpoint, row_id, term, weight`` and
    the ``size`` of each endpoint: ``rows`` are (row_id, weight), ``top`` and ``n`` the largest
    weight and the number of them. Postings without a weight above 0 score nothing and are
    left out, as are those of endpoints without a size."""
    ranges = F.greatest(F.lit(1), F.ceil(F.col("size") / rows)).cast("long")
    placed = postings.where("weight > 0").join(sizes.select("endpoint", "size"), "endpoint").withColumns({
        "range": F.pmod(F.xxhash64("row_id"), ranges),
        "band": F.least(F.floor(F.col("weight") * BANDS), F.lit(BANDS - 1)).cast("int"),
    })
    return placed.groupBy(*_AT).agg(F.max("weight").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("row_id", "weight")).alias("rows"))


def _scores(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """``generic, endpoint, row_id, score_sparse`` over the postings of the chosen blocks."""
    read = blocks.select(*_AT, "rows").join(shuffled(chosen.select("generic", *_AT, "_q")), _AT)
    return read.select(*_ASKED, "_q", F.inline("rows")).groupBy(*_ASKED, "row_id").agg(F.sum(F.col("weight") * F.col("_q")).alias("score_sparse"))


def _of_terms(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """The blocks of terms that are asked for; others are not shuffled."""
    return blocks.join(queries.select("term").distinct(), "term", "left_semi")


def _ranked(rows: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The first ``k`` of each placeholder and endpoint: in parts first, so that a frequent
    term's rows are not sorted in one task."""
    for keys in ([*_ASKED, F.pmod(F.xxhash64(tie), F.lit(16))], _ASKED):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), tie))).where(F.col("rank") <= k)
    return rows


def chosen_blocks(terms: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Heads of the blocks to read: ``generic, endpoint, term, range, band, n, _q``."""
    met = stored(shuffled(blocks.drop("rows")).join(query_weights(terms, queries), ["endpoint", "term"]), "block-heads")
    most = met.groupBy("generic", "endpoint", "range", "term").agg(F.max(F.col("_q") * F.col("top")).alias("_most"))
    bounds = stored(most.groupBy(*_ASKED, "range").agg(F.sum("_most").alias("_bound")), "block-bounds")
    first = _ranked(bounds, k, "_bound", "range").select(*_ASKED, "range")
    best = _ranked(_scores(shuffled(met).join(first, [*_ASKED, "range"]), _of_terms(blocks, queries)), k, "score_sparse", "row_id")
    floor = best.groupBy(*_ASKED).agg(F.when(F.count("*") >= k, F.min("score_sparse")).alias("_floor"))
    slack = 2 * 10**-DIGITS  # scores that round to the floor's tie with it
    near = bounds.join(floor, _ASKED, "left").withColumn("_need", F.coalesce("_floor", F.lit(0.0)) - slack).where("_bound >= _need")
    others = F.col("_bound") - F.col("_most")
    left = most.join(shuffled(near), [*_ASKED, "range"]).select(*_ASKED, "range", "term", (F.col("_need") - others).alias("_need"))
    return shuffled(met).join(left, ["generic", "endpoint", "range", "term"]).where(F.col("_q") * F.col("top") >= F.col("_need")).select("generic", *_AT, "n", "_q")


def top_sparse(terms: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``generic, endpoint, rank, row_id, score_sparse``: the ``k`` rows of largest cosine
    in each endpoint, rounded, ties to the smaller row; rows without a common term are no
    result. ``queries``: ``generic, term, tf``. Blocks are read three times (once the heads
    alone), so they should be a table."""
    scores = _scores(chosen_blocks(terms, blocks, queries, k), _of_terms(blocks, queries)).withColumn("score_sparse", F.round("score_sparse", DIGITS))
    return _ranked(scores, k, "score_sparse", "row_id").select(*_ASKED, "rank", "row_id", "score_sparse")


def reads(terms: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``generic, endpoint, postings, postings_read``: of the terms asked for, and of those
    in the blocks that the last pass reads."""
    every = blocks.drop("rows").join(query_weights(terms, queries), ["endpoint", "term"]).groupBy(*_ASKED).agg(F.sum("n").alias("postings"))
    read = chosen_blocks(terms, blocks, queries, k).groupBy(*_ASKED).agg(F.sum("n").alias("postings_read"))
    return every.join(read, _ASKED, "left").fillna(0, ["postings_read"])
