"""Chat formatting: collapse of cumulative snapshots, then rendering.

A conversation is the turns of one ``conv_id`` in the order of turn (null first), role,
MD5 of the text; rows that repeat turn, role and text count once. Null role reads ``user``,
null text is empty. Rows without a conv_id belong to no conversation and go. A
conversation whose turns begin a longer one goes; of equal conversations the smallest
conv_id stays. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, whole

#: One turn of the rendered text.
TURN = ("<|", "|>\n", "\n<|end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), whole("text").alias("text"))


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that stay. Only hashes are
    shuffled; prefix hashes are exclusive ors of hashes that include the position."""
    turns = _turns(conversations).select("conv_id", "turn", "role", F.md5("text").alias("_m"))
    turns = turns.groupBy("conv_id", "turn", "role", "_m").agg(F.lit(1).alias("_one"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "_m")
    turns = turns.withColumn("_k", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prefix = turns.select("conv_id", "_k", F.bit_xor(F.xxhash64("_k", "role", "_m")).over(upto).alias("_x"), F.bit_xor(F.xxhash64("_m", "role", "_k")).over(upto).alias("_y"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))
    prefix = stored(prefix, "chat-prefix")
    last = prefix.where("_k = n_turns").groupBy("_k", "_x", "_y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = prefix.where("_k < n_turns").select("_k", "_x", "_y").distinct()
    return last.join(shorter, ["_k", "_x", "_y"], "left_anti").select("conv_id", F.col("_k").cast("long").alias("n_turns"), "copies")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered``: the text of each kept conversation."""
    a, b, c = TURN
    turns = _turns(conversations).join(kept, "conv_id")
    turns = turns.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.md5("text").alias("_m"), "text"))).alias("_t"))
    line = lambda t: F.concat(F.lit(a), t["role"], F.lit(b), t["text"], F.lit(c))
    return turns.select("conv_id", "n_turns", "copies", F.concat_ws("", F.transform("_t", line)).alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    return render(conversations, stored(maximal(conversations), "chat-kept"))


def op3(spark, sf_dir):
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM t),
p AS (SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(line, '') OVER (w ROWS UNBOUNDED PRECEDING) AS pre
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
l AS (SELECT k, pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY k, pre)
SELECT l.conv_id, l.k AS n_turns, l.copies, l.pre AS rendered FROM l
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = l.k AND p.pre = l.pre)
"""
