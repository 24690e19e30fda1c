"""Spot signatures: chains of content words that follow common words (anchors).

Each anchor with ``CHAIN`` content words after it gives one signature (anchors between
them are passed over). A text without any has one signature of all its words; a text
without words has none and an empty fingerprint. The fingerprint is the sorted set of
signatures, 8 hex digits each. Likeness is the Jaccard coefficient of two sets (two
empty sets: 1), pruned where the set lengths alone rule out the floor asked for. Null
text counts as empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import documents, stored, whole
from .links import components, confirm_by_sets

#: Common words of English, German, French and Spanish that start chains.
ANCHORS = (
    "a an and are as at be by can do for from had has have he her his i in is it its not of on or she that the their they this to was we were what which who will with you "
    "als am auf aus auch bei das dem den der des die ein eine einer er es hat ich im ist man mit nach nicht noch oder sich sie sind um und uns von wie wir zu zum zur "
    "au aux avec ce ces dans de du elle en est et il je la le les leur lui mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "al como con del el ella ello lo los las más me mi muy no nos o para pero por sin su sus te y ya"
).split()
CHAIN = 2
#: Ids in a range of neighbouring documents, about.
RANGE = 500
#: Quantiles of the ids between which ranges are cut.
CELLS = 256
NEAR = 0.8


def signatures(text: Column) -> Column:
    """``array<bigint>``: the sorted distinct signatures of a text, one expression of
    built-in functions. The j-th anchor at word p has p - j content words before it."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    anchor = lambda w: w.isin(ANCHORS)

    def of(s):
        chain = lambda p, j: F.when(p - j + CHAIN <= F.size(s["c"]), F.pmod(F.xxhash64(F.get(s["w"], p), *[F.get(s["c"], p - j + k) for k in range(CHAIN)]), F.lit(1 << 32)))
        spots = F.filter(F.transform(s["p"], chain), lambda x: x.isNotNull())
        all_words = F.pmod(F.xxhash64(s["w"]), F.lit(1 << 32))
        some = F.array_sort(F.array_distinct(spots))
        return F.when(F.get(s["w"], F.lit(0)) == "", F.array().cast("array<bigint>")).when(F.size(some) == 0, F.array(all_words)).otherwise(some)

    # transform over a one-element array binds a value once for all its uses
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    parts = lambda w: F.struct(w.alias("w"), F.filter(w, lambda x: ~anchor(x)).alias("c"), F.filter(F.transform(w, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull()).alias("p"))
    return once(words, lambda w: once(parts(w), of))


def fingerprint(sigs: Column) -> Column:
    return F.concat_ws("", F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without intersecting where the shorter set is
    too short to reach ``floor``."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    full = F.when(n + m == 0, F.lit(1.0)).otherwise(both / (n + m - both))
    return full if floor <= 0 else F.when(F.least(n, m) < F.greatest(n, m) * floor, F.lit(0.0)).otherwise(full)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, signatures, fingerprint``, a row per input row."""
    out = docs.select(F.col(id_col).alias("doc_id"), signatures(whole(text_col)).alias("signatures"))
    return out.withColumn("fingerprint", fingerprint(F.col("signatures")))


def near_groups(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """``doc_id, group_id, links``: documents whose signature sets are alike.

    Equal sets stand for one class. Classes are dealt by set length: a class meets only
    lengths in ``[n * t, n / t]``, and only through the rarest signatures of its set, of
    which a like set must share one. Links are confirmed on whole sets."""
    t = float(threshold)
    rows = stored(fingerprints(docs).select("doc_id", F.xxhash64("fingerprint").alias("_f"), F.xxhash64(F.lit("q"), "fingerprint").alias("_g"), "signatures"), "spot-rows")
    classes = stored(rows.groupBy("_f", "_g").agg(F.min("doc_id").alias("rid")), "spot-classes")
    sets = rows.join(classes.withColumnRenamed("rid", "doc_id"), ["doc_id", "_f", "_g"], "left_semi").dropDuplicates(["doc_id"]).where("size(signatures) > 0")
    sets = stored(sets.select(F.col("doc_id").alias("rid"), F.col("signatures").alias("items")), "spot-sets")
    flat = sets.select("rid", F.size("items").alias("n"), F.explode("items").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("df", "s"))
    first = flat.join(often, "s").withColumn("r", rank).where(f"r <= n - cast(ceil({t} * n) as int) + 1")
    # lengths a and b can be alike only if their bands are equal or next to each other
    band = F.floor(F.log("n") / F.log(F.lit(1 / t))).cast("int") if t < 1 else F.col("n")
    own = stored(first.select("rid", "n", "s", band.alias("band")), "spot-prefix")
    other = own.select(F.col("rid").alias("b"), F.col("n").alias("m"), "s", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = own.join(other, ["s", "band"]).where(f"rid < b and least(n, m) >= {t} * greatest(n, m)").select(F.col("rid").alias("a"), "b").distinct()
    edges = confirm_by_sets(stored(pairs, "spot-pairs"), sets, t)
    labels = components(edges)
    links = edges.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    of = stored(classes.join(labels, "rid", "left").join(links, "rid", "left").select("_f", "_g", F.coalesce("label", "rid").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")), "spot-of")
    return rows.select("doc_id", "_f", "_g").join(of, ["_f", "_g"]).select("doc_id", "group_id", "links")


def following(ids: DataFrame) -> DataFrame:
    """``id, next_id`` of distinct longs: the next smaller one, after the smallest the
    largest. Found in ranges, with one row per range compared across ranges."""
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = stored(ids.repartitionByRange(parts, F.desc("id")).withColumn("_pid", F.spark_partition_id()), "spot-ids")
    ends = ids.groupBy("_pid").agg(F.max("id").alias("hi")).orderBy("_pid").collect()  # one row per range
    step = [(e["_pid"], ends[(i + 1) % len(ends)]["hi"]) for i, e in enumerate(ends)]
    step = F.broadcast(spark.createDataFrame(step, "_pid int, _next long"))
    inside = F.lead("id").over(Window.partitionBy("_pid").orderBy(F.desc("id")))
    return ids.withColumn("_in", inside).join(step, "_pid").select("id", F.coalesce("_in", "_next").alias("next_id"))


def _ranges(docs: DataFrame) -> Column | None:
    """Names of ranges of ids: cells between ``CELLS`` quantiles, each cut evenly into
    ranges of about ``RANGE`` ids, so that a far id widens its own cell's ranges alone."""
    at = [i / CELLS for i in range(1, CELLS)]
    borders = docs.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0]
    if borders is None:
        return None
    borders = sorted(set(borders))
    # number of borders not above the id, by binary search
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    listed = F.array(*[F.lit(b) for b in borders])
    at_step = lambda pos, s: pos + F.when(F.get(listed, pos + s - 1) <= F.col("doc_id"), s).otherwise(F.lit(0))
    cell = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), at_step)
    found = docs.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).collect()  # a row a cell
    lo, width = ([None] * (len(borders) + 1) for _ in range(2))
    for r in found:
        lo[r["cell"]], width[r["cell"]] = r["lo"], max(1, -(-(r["hi"] - r["lo"] + 1) * RANGE // r["n"]))
    of = lambda values: F.get(F.array(*[F.lit(v).cast("decimal(20, 0)") for v in values]), cell)
    inside = (F.col("doc_id").cast("decimal(20, 0)") - of(lo)) / of(width)
    return F.concat_ws("/", cell, F.floor(inside).cast("string"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, signatures, next_text, next_signatures`` by descending doc_id.

    Rows are dealt to ranges of about ``RANGE`` ids and every range also gets the first
    row of the range after it, so texts are shuffled once and no task sees more than its
    ranges."""
    name = _ranges(docs)
    docs = docs.withColumn("_range", F.lit("") if name is None else name)
    first = stored(docs.groupBy("_range").agg(F.max("doc_id").alias("id")), "spot-first")
    after = following(first.select("id")) if name is not None else first.select("id", F.col("id").alias("next_id"))
    guests = first.join(after, "id").select("_range", F.col("next_id").alias("doc_id"))
    guests = docs.drop("_range").join(stored(guests, "spot-guests"), "doc_id").select("_range", "doc_id", "text", F.lit(True).alias("_guest"))
    rows = docs.select("_range", "doc_id", "text", F.lit(False).alias("_guest")).unionByName(guests)
    rows = rows.repartition("_range").withColumn("signatures", signatures(F.col("text")))
    w = Window.partitionBy("_range").orderBy("_guest", F.desc("doc_id"))
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_signatures": F.lead("signatures").over(w)})
    return rows.where("not _guest").drop("_range", "_guest")


def op1(spark, sf_dir):
    """Rows without an id go; rows that repeat an id follow each other in any order."""
    rows = with_next(documents(spark, sf_dir).where("doc_id is not null").select("doc_id", whole("text").alias("text")))
    n = F.char_length("text")
    edited = F.expr("concat(substring(text, 1, cast(char_length(text) - char_length(text) div 2 as int)), substring(next_text, 1, cast(char_length(text) div 2 as int)))")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "signatures", "next_signatures", edited.alias("_edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "signatures", "next_signatures", signatures(F.col("_edited")).alias("_edited_sig"))
    a, b, c = F.col("signatures"), F.col("_edited_sig"), F.col("next_signatures")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
