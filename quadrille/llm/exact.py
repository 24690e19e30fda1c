"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Null text counts as empty, so null and empty texts form one group. Texts are equal
when identical after each run of ASCII white space became one space. Of equal texts
the smallest ``doc_id`` stays (a null id is larger than any other); rows that repeat
an id with the same text share one decision. An empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, documents, free, stored, temporary, text_key, whole, without

#: Code points hashed in the second step.
PREFIX = 128


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False, keep: tuple = ()) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` (and ``keep``), a row per input row.

    Each step groups what the step before left and lets go of rows that are alone in
    their group; only ids and hashes are shuffled. The full text of surviving rows is
    read again for the full hash. With ``digest`` the caller wants the SHA-256 of
    every text (``text_sha256``): then the first scan computes it and the last step
    reuses it instead of reading survivors again.
    """
    ids, norm = F.col(id_col).alias("doc_id"), normalised(text_col)
    full = F.sha2(F.col("_norm"), 256).alias("text_sha256")
    head = F.xxhash64(F.substring("_norm", 1, prefix)).alias("_head")
    rows = docs.select(ids, norm.alias("_norm"), *keep).select("doc_id", F.char_length("_norm").alias("_len"), head, *([full] if digest else []), *keep)
    rows = stored(rows, "exact-rows")
    alone = lambda df: df.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})

    by_len = stored(rows.groupBy("_len").count().where("count > 1").select("_len"), "exact-len")
    by_head = stored(rows.join(by_len, "_len", "left_semi").groupBy("_len", "_head").count().where("count > 1").select("_len", "_head"), "exact-head")
    alone_len = rows.join(by_len, "_len", "left_anti")
    alone_head = rows.join(by_len, "_len", "left_semi").join(by_head, ["_len", "_head"], "left_anti")
    left = rows.join(by_head, ["_len", "_head"], "left_semi")
    if not digest:
        again = docs.select(ids, norm.alias("_norm"), *keep).select("doc_id", F.char_length("_norm").alias("_len"), head, "_norm", *keep)
        left = again.join(by_head, ["_len", "_head"], "left_semi").withColumn("text_sha256", full)
    left = stored(left.select("doc_id", "_len", "_head", "text_sha256", *keep), "exact-left")
    groups = stored(left.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    grouped = left.join(groups, "text_sha256")
    cols = ["doc_id", "keep_id", "group_size", *(["text_sha256"] if digest else []), *keep]
    out = alone(alone_len).select(cols).unionByName(alone(alone_head).select(cols)).unionByName(grouped.select(cols))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows that repeat both id
    and text, one stays."""
    key = free(docs, "key")
    keyed = docs.withColumn(key, text_key(normalised("text")))
    with temporary(docs.sparkSession):
        decided = stored(exact_dedup(keyed, keep=(key,)), "exact-decided")
        gone = stored(decided.where("not kept").select("doc_id", key).distinct(), "exact-dropped", lasting=True)
        twice = decided.where("kept and group_size > 1").groupBy("doc_id", key).count().where("count > 1").limit(1).count()
    left = without(keyed, gone, key)
    return (left.dropDuplicates(["doc_id", key]) if twice else left).select(docs.columns)


def op4(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
