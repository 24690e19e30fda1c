"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

Golden-ratio points, mapped through the cumulative target shares, name a source for
every slot of the mix; the rank of a slot within its source picks the next block of
that source's shuffled text, beginning anew when its blocks are used up. Null source
is a source of its own, sorted last; null text has size 0. Documents of size 0 are
taken 0 words. Repeated rows are separate documents. An empty table gives an empty
result. Sources are a mixing configuration: their names and sums (one row each) go to
the driver, documents never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, documents, free, stored, temporary, text_key, whole

#: Slots aimed at, and the largest block in words.
SLOTS, LARGEST_BLOCK = 100_000, 65_536
#: Rows of a source between two stored offsets of its running size.
RUN = 500
GOLDEN = 0.6180339887498949
CAP = 3
_GRID = 1024


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words wanted of each source: weights 1, 2, 3 by code point, null last; targets
    stop at ``CAP`` times the size and the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out: dict = {}
    free, rest = list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > CAP * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        for s in full:
            out[s] = float(CAP * sizes[s])
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def schedule(spark: SparkSession, target: list[float], blocks: list[int], block: int) -> DataFrame:
    """``_src, _block, times``: how often the slots of the mix name a block. Slots are
    ranked within their source in chunks, so that no source is ranked in one task."""
    total = sum(target)
    slots = max(1, round(total / block))
    bounds, at = [], 0.0
    for i, t in enumerate(target):
        if t > 0:
            bounds.append((i, at, at + t / total))
        at += t / total
    bounds[-1] = (bounds[-1][0], bounds[-1][1], 2.0)
    # intervals cut along a grid, so that point and interval meet by equality
    cells = [(g, *b) for b in bounds for g in range(int(b[1] * _GRID), min(_GRID - 1, int(b[2] * _GRID)) + 1)]
    cells = spark.createDataFrame(cells, "_cell int, _src int, _lo double, _hi double")
    points = spark.range(slots).select("id", F.expr(f"(id + 0.5D) * {GOLDEN}D").alias("_x")).withColumn("_p", F.expr("_x - floor(_x)"))
    points = points.withColumns({"_cell": F.expr(f"cast(floor(_p * {_GRID}) as int)"), "_chunk": F.expr("id div 4096")})
    named = points.join(F.broadcast(cells), "_cell").where("_p >= _lo and _p < _hi").select("id", "_chunk", "_src")
    counts = named.groupBy("_src", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_src", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = named.withColumn("_r", F.row_number().over(Window.partitionBy("_src", "_chunk").orderBy("id")) - 1).join(offsets, ["_src", "_chunk"])
    n_blocks = F.broadcast(spark.createDataFrame(list(enumerate(blocks)), "_src int, _blocks long"))
    ranked = ranked.withColumn("_rank", F.expr("_r + _before")).join(n_blocks, "_src").where(f"_rank < {CAP} * _blocks")
    return ranked.groupBy("_src", F.expr("_rank % _blocks").alias("_block")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", keep: tuple = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` (and ``keep``), a row per
    document. ``taken`` is at most 3 times ``size``; a source's taken words differ from
    its target by a few blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), whole(text_col)).alias("_h"), *keep)
    rows = stored(rows, "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    if not found:
        return rows.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), *keep)
    size = {r["source"]: int(r["s"]) for r in found}
    want = targets(size)
    names = list(size)
    total, most = sum(size.values()), max(r["n"] for r in found)
    block = max(1, min(LARGEST_BLOCK, total // SLOTS))
    src = F.broadcast(spark.createDataFrame([(s, i, size[s], float(want.get(s, 0.0))) for i, s in enumerate(names)], "_name string, _src int, source_size long, target double"))
    rows = rows.join(src, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    zero = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    if not total:
        return zero.select("doc_id", "source", "size", "source_size", "target", "taken", *keep)
    # running size within the source in shuffled order: within runs, then over runs
    runs = max(1, -(-most // RUN))
    rows = rows.where("size > 0").withColumn("_run", F.pmod(F.col("_h"), F.lit(runs)))
    sums = rows.groupBy("_src", "_run").agg(F.sum("size").alias("_s"))
    over = Window.partitionBy("_src").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_src", "_run", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_src", "_run").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["_src", "_run"]).withColumn("_at", F.expr("_at + _off")).drop("_off", "_run", "_h")
    placed = stored(placed, "mix-placed")
    pieces = placed.withColumn("_block", F.explode(F.expr(f"sequence(_at div {block}, (_at + size - 1) div {block})")))
    pieces = pieces.withColumn("_words", F.expr(f"least(_at + size, (_block + 1) * {block}) - greatest(_at, _block * {block})"))
    plan = schedule(spark, [want.get(s, 0.0) for s in names], [-(-size[s] // block) for s in names], block)
    met = pieces.join(plan, ["_src", "_block"], "left")
    key = ["_src", "_at", "doc_id", "source", "size", "source_size", "target", *keep]
    taken = met.groupBy(*key).agg(F.coalesce(F.sum(F.expr("_words * times")), F.lit(0)).alias("taken"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", *keep]
    return taken.select(cols).unionByName(zero.select(cols))


def mixed_documents(docs: DataFrame, copy_col: str | None = None) -> DataFrame:
    """The documents of the mix with all their columns, each repeated as often as the
    mix takes it (taken words over size, rounded); what it takes less than half of goes,
    and so do documents of size 0. The blocks a source gives once more than others lie
    together in its shuffled order, so of all its documents only those at the two ends are
    rounded, each by half its size at most. Rows that repeat id and text share the sum of
    their copies. ``copy_col`` names a further column that numbers the copies of a row
    from 1."""
    key, gone, times, rows, extra, n = (free(docs, x) for x in ("key", "id", "times", "rows", "extra", "copy"))
    keyed = docs.withColumn(key, text_key())
    with temporary(docs.sparkSession):
        taken = mix(keyed, keep=(key,)).select(F.col("doc_id").alias(gone), F.col(key).alias(times), F.expr("cast(round(taken / nullif(size, 0)) as int)").alias(rows)).where(F.col(rows) > 0)
        plan = taken.groupBy(gone, times).agg(F.sum(rows).alias("_t"), F.count("*").alias("_n"))
        same = keyed.groupBy("doc_id", key).agg(F.count("*").alias("_n")).where("_n > 1")
        same = stored(same.select(F.col("doc_id").alias("_i"), F.col(key).alias("_k"), F.col("_n").alias("_all")), "mix-same")
        plan = plan.join(same, F.col(gone).eqNullSafe(F.col("_i")) & (F.col(times) == F.col("_k")), "left").withColumn("_all", F.coalesce("_all", F.lit(1)))
        plan = stored(plan.select(gone, times, F.expr("cast(_t div _all as int)").alias(rows), F.expr("cast(_t % _all as int)").alias(extra)), "mix-times", lasting=True)
    met = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(key) == F.col(times)))
    every = met.where(F.col(rows) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(rows)))).select(*docs.columns, n)
    # what does not divide evenly goes to one of the rows that repeat
    one = met.where(F.col(extra) > 0).groupBy(gone, key).agg(F.first(F.struct(*docs.columns)).alias("_row"), F.first(rows).alias("_done"), F.first(extra).alias("_more"))
    rest = one.select("_row.*", F.explode(F.sequence(F.col("_done") + 1, F.col("_done") + F.col("_more"))).alias(n))
    out = every.unionByName(rest)
    return out.select(*docs.columns, *([F.col(n).alias(copy_col)] if copy_col else []))


def op9(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
