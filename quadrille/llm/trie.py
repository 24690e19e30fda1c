"""Prefix trie of conversations as succinct level-order tries.

The turns of a conversation are its rows in the order of turn (null first), role, MD5 of the
text; null role and text are empty, rows that repeat are turns of their own, and rows
without a conv_id belong to no conversation. A conversation is rebuilt with the first ``h``
turns of the conversation it may have been forked from (see ``rebuilt``). A node is a
distinct sequence of first turns; its key is the depth and two exclusive-or hashes over
position, role and text. Equal prefixes are aggregated before they are shuffled, so copies
of a conversation cost one row a task.

Nodes with more than a ``HEAVY``-th of all rows as members are the upper levels: fewer than
``HEAVY`` of them exist, whatever the input, since every row is a member of one node. Below them each subtree is whole in one shard. A shard is a forest whose nodes numpy
sorts in level order, with a LOUDS bit vector (a one for every child, then a zero) and arrays
of labels; parents are ranks of zeros, and counts roll up from the last level to the first by
``add.at``. The tops of the shards are then summed by parent and the upper levels, a trie
of bounded size, are rolled up in the same way.

The ids of the conversations that end at a node are hashed in ascending order: joined in
pieces by ranges of ids, and the pieces streamed through SHA-256. The turns of one
conversation are ordered in one task, which may spill. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, stored, temporary, whole

#: Conversations of one family, and turns at most that a fork shares with its base.
FAMILY, SHARED = 20, 4
#: Nodes with more than a HEAVY-th of the rows as members, and with more than LEAST.
HEAVY, LEAST = 4096, 64
#: Nodes of a shard, about; ids joined to a piece, as a power of two.
SHARD, PIECE = 200_000, 8
_NONE = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, k, tx, ty, words``: turns numbered from 1, with two hashes of role and text."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), whole("role").alias("_role"), F.md5(whole("text")).alias("_m"), F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("words"))
    w = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_m")
    return rows.select("conv_id", F.row_number().over(w).alias("k"), F.xxhash64(F.lit("x"), "_role", "_m").alias("tx"), F.xxhash64("_m", "_role", F.lit("y")).alias("ty"), "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and ``conv_id, n`` of all: the first h turns of
    conversation c - c % 20 (the sign as in SQL), then those of c after its first h, where
    h is crc32(c) % 4."""
    own = turns.groupBy("conv_id").agg(F.max("k").alias("_own"))
    own = own.withColumns({"_h": (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int"), "_base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    bases = own.where("conv_id = _base").select(F.col("conv_id").alias("_base"), F.col("_own").alias("_has"))
    convs = own.join(bases, "_base", "left").withColumn("_taken", F.least("_h", F.coalesce("_has", F.lit(0))))
    convs = stored(convs.select("conv_id", "_base", "_h", "_taken", (F.col("_taken") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))).alias("n")), "trie-convs")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("k") < SHARED)).withColumnRenamed("conv_id", "_base")
    first = convs.join(heads, "_base").where("k <= _h").select("conv_id", "k", "tx", "ty", "words")
    rest = turns.join(convs, "conv_id").where("k > _h").select("conv_id", (F.col("_taken") + F.col("k") - F.col("_h")).alias("k"), "tx", "ty", "words")
    return first.unionByName(rest), convs.select("conv_id", "n")


def paths(turns: DataFrame) -> DataFrame:
    """Turns with the key of their prefix (``depth, x, y``) and of the prefix before it."""
    w = Window.partitionBy("conv_id").orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", F.col("k").alias("depth"), F.xxhash64("tx", "ty").alias("label"), "words", F.bit_xor(F.xxhash64("k", "tx", "ty")).over(upto).alias("x"), F.bit_xor(F.xxhash64("ty", "k", "tx")).over(upto).alias("y"))
    before = Window.partitionBy("conv_id").orderBy("depth")
    return rows.select("*", F.lag("x", 1, 0).over(before).alias("px"), F.lag("y", 1, 0).over(before).alias("py"))


class Louds:
    """A forest in level order. ``parent`` holds indexes of nodes or -1; nodes are sorted
    by level, then by parent."""

    def __init__(self, level: np.ndarray, parent: np.ndarray, label: np.ndarray):
        n = len(parent)
        children = np.bincount(parent + 1, minlength=n + 1)  # of the root above all tops, then of each node
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(children) + np.arange(n + 1)] = 0
        self.bits, self.size, self.label, self.level = np.packbits(bits, bitorder="little"), n, label, level

    def _ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits, count=2 * self.size + 1, bitorder="little"))

    def parents(self) -> np.ndarray:
        """The zeros before the i-th one, less the root's: the parent of node i."""
        return self._ones() - np.arange(self.size) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.size + 1, bitorder="little") == 0)
        return np.diff(zeros) - 1

    def roll_up(self, *values: np.ndarray) -> None:
        """Adds every node's values to its parent's, from the last level to the first."""
        parent = self.parents()
        for nodes in reversed(_groups(self.level)):
            nodes = nodes[parent[nodes] >= 0]
            for v in values:
                np.add.at(v, parent[nodes], v[nodes])


def level_order(depth: np.ndarray, key: np.ndarray, above: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the nodes by level, parent, conversation; and in that order their levels,
    counted from the tops, and their parents. Tops, whose parent (``above``) is not here,
    have -1; they may lie at several depths."""
    up, level = np.full(len(depth), -1, np.int64), np.zeros(len(depth), np.int64)
    last = np.zeros(0, np.int64)
    for rows in _groups(depth):
        if len(last) and depth[last[0]] == depth[rows[0]] - 1:
            found = np.minimum(np.searchsorted(key[last], above[rows]), len(last) - 1)
            met = key[last][found] == above[rows]
            up[rows[met]] = last[found[met]]
            level[rows[met]] = level[last[found[met]]] + 1
        last = rows[np.argsort(key[rows])]
    order, place, start = [], np.full(len(depth) + 1, -1, np.int64), 0  # the last place is that above all tops
    for rows in _groups(level):
        rows = rows[np.lexsort((conv[rows], place[up[rows]]))]
        place[rows] = np.arange(start, start + len(rows))
        start += len(rows)
        order.append(rows)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order, level[order], place[up[order]]


def _groups(values: np.ndarray) -> list[np.ndarray]:
    """Places of equal values, from the smallest value to the largest."""
    at = np.argsort(values, kind="stable")
    return np.split(at, np.flatnonzero(np.diff(values[at])) + 1) if len(at) else []


_KEY = np.dtype([("x", np.int64), ("y", np.int64)])
ROLLED = "depth int, x long, y long, px long, py long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def rolled_up(table: pa.Table) -> pa.Table:
    """The nodes of one shard with parents, children, leaves and saved tokens. What their
    subtrees have outside the shard comes in the ``more_`` columns."""
    c = {k: table.column(k).to_numpy() for k in table.column_names if k != "ends_sha256"}
    pair = lambda a, b: np.rec.fromarrays([c[a], c[b]], dtype=_KEY)
    order, level, parent = level_order(c["depth"], pair("x", "y"), pair("px", "py"), c["conv_id"])
    c = {k: v[order] for k, v in c.items()}
    trie = Louds(level, parent, c["label"])
    parent = trie.parents()
    children = trie.degrees() + c["more_children"]
    leaves = c["more_leaves"] + (children == 0)
    saved = (c["n_convs"] - 1) * c["words"] + c["more_saved"]
    trie.roll_up(leaves, saved)
    top = parent < 0
    out = {k: pa.array(c[k]) for k in ("depth", "x", "y", "px", "py", "conv_id")}
    out["parent_conv_id"] = pa.array(c["conv_id"][parent] if len(parent) else parent, mask=top)
    out |= {"n_convs": pa.array(c["n_convs"]), "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved)}
    return pa.table(out | {"ends_sha256": table.column("ends_sha256").take(pa.array(order)).cast(pa.string()), "top": pa.array(top)})


def ends(last: DataFrame) -> DataFrame:
    """``depth, x, y, ends_sha256`` of ``depth, x, y, conv_id``, the conversations that end
    at a node. Ids are joined by ranges of 256, which no node exceeds, and the pieces of
    a node pass through one digest in their order."""
    key = ["depth", "x", "y"]
    piece = last.groupBy(*key, F.shiftright("conv_id", PIECE).alias("_at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("_ids"))
    piece = piece.repartition(*key).sortWithinPartitions(*key, "_at").select(*key, "_ids")

    def digests(batches):
        node, digest, done = None, None, []

        def rows():
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*key, "ends_sha256"])

        for b in batches:
            for *k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) >= 4096:
                yield rows()
                done.clear()
        if node:
            done.append((*node, digest.hexdigest()))
            yield rows()

    return piece.mapInArrow(digests, "depth int, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, a row per node."""
    spark, key = conversations.sparkSession, ["depth", "x", "y"]
    with temporary(spark):
        turns, convs = rebuilt(stored(ordered(conversations), "trie-turns"))
        rows = stored(paths(turns), "trie-paths")
        total = rows.count()
        nodes = rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("label").alias("label"), F.first("words").alias("words"))
        nodes = stored(nodes, "trie-nodes")
        n_nodes = nodes.count()
        most = max(LEAST, total // HEAVY)
        # the upper levels, fewer than HEAVY nodes: each of the rows is a member of one node
        upper = stored(nodes.where(F.col("n_convs") > most), "trie-upper")
        # how deep each conversation runs through them, and the key of the node below
        heavy = F.broadcast(upper.select(*key, F.lit(1).alias("_heavy")))
        w = Window.partitionBy("conv_id")
        below = rows.join(heavy, key, "left").select("conv_id", *key, "_heavy", F.min(F.when(F.col("_heavy").isNull(), F.struct("depth", "x", "y"))).over(w).alias("_top"))
        shard = F.pmod(F.xxhash64("_top"), F.lit(max(1, -(-n_nodes // SHARD)))).cast("int")
        of = below.where("_heavy is null").groupBy(*key).agg(F.first(shard).alias("shard"))
        n = F.coalesce("n", F.lit(0))
        lasts = convs.withColumnRenamed("n", "depth").where("depth > 0").join(rows.select("conv_id", *key), ["conv_id", "depth"]).select(*key, "conv_id")
        lasts = lasts.unionByName(convs.where(n == 0).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id"))
        ended = stored(ends(lasts), "trie-ends")
        zero = [F.lit(0).cast("long").alias(c) for c in ("more_children", "more_leaves", "more_saved")]
        digest = F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")
        columns = [*key, "px", "py", "conv_id", "label", "n_convs", "words"]
        light = nodes.join(of, key).join(ended, key, "left").select("shard", *columns, *zero, digest)
        light = light.groupBy("shard").applyInArrow(rolled_up, ROLLED)
        light = stored(light, "trie-light", lasting=True)
        # the tops of the shards meet the upper levels
        root = convs.agg(F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y")], F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("label"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words")).where("n_convs > 0")
        every = stored(upper.select(columns).unionByName(root.select(columns)), "trie-levels")
        met = light.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        more = [F.coalesce(c, F.lit(0)).alias(c) for c in ("more_children", "more_leaves", "more_saved")]
        levels = every.join(met, key, "left").join(ended, key, "left").select(F.lit(0).alias("_one"), F.col("depth"), "x", "y", F.coalesce("px", F.lit(0)).alias("px"), F.coalesce("py", F.lit(0)).alias("py"), "conv_id", "label", "n_convs", "words", *more, digest)
        levels = stored(levels.groupBy("_one").applyInArrow(rolled_up, ROLLED), "trie-rolled", lasting=True)
    above = F.broadcast(levels.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("_above"), F.lit(True).alias("top")))
    light = light.join(above, ["depth", "px", "py", "top"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    cols = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return light.select(cols).unionByName(levels.select(cols))


def op13(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 by bits, as a fold over the bytes of a number's digits.
_CRC = """xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999])),
  lambda a, v: CASE WHEN v < 999 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END))"""

OP13_SQL = rf"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS turn_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, ({_CRC} % 4)::INTEGER AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, k, turn_key, words FROM c JOIN t ON t.conv_id = c.base AND k <= h UNION ALL SELECT conv_id, 1, k, turn_key, words FROM c JOIN t USING (conv_id) WHERE k > h),
p AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(turn_key, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
a AS (SELECT conv_id, words, depth, path, depth = max(depth) OVER (PARTITION BY conv_id) AS is_last FROM p
      UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM p) FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '') AS ends FROM a GROUP BY depth, path),
ch AS (SELECT depth - 1 AS depth, left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, path)),
s AS (SELECT d AS depth, left(path, 32 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN n up ON up.depth = m.depth - 1 AND up.path = left(m.path, 32 * (m.depth - 1))
"""
