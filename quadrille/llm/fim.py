"""Fill-in-the-middle over an index of distinct texts.

A text's boundary list holds the code point offsets at which its lines end, as an
Elias-Fano list. Rows with the same text are grouped: one scan hashes every text and lets
each task send a text once, the other copies send their id alone; sorted by hash, the
text comes first, is compared with every further copy of it that other tasks sent, and
its list is computed once for all the rows that follow. Each row picks its seeded cut
from the list. Texts that more than a ``SPREAD``-th of all rows share are dealt to several
tasks, so whole texts are shuffled once at most and no group is held in memory.

Null text counts as empty, which is ``plain``; so is a text that contains a mark. A null
id is cut as the empty id; rows that repeat are cut each, equal ids alike. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, documents, whole

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are cut, and percent of those with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: A text that more than a SPREAD-th of the rows share is dealt out; there are fewer than
#: SPREAD such texts. LEAST rows of one text always stay together.
SPREAD, LEAST = 4096, 64
#: Hashes a task remembers (it sends a text again after so many others), and bytes of an
#: output batch: bound memory, not results.
REMEMBERED, OUT_BYTES = 200_000, 16 << 20

_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


class EliasFano:
    """A rising list of numbers up to ``universe``: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        n = self.n = len(values)
        self.width = max(0, (universe // n).bit_length() - 1) if n else 0
        high = np.zeros((universe >> self.width) + n + 1 if n else 0, np.uint8)
        high[(values >> self.width) + np.arange(n)] = 1
        self.high = np.packbits(high, bitorder="little")
        self.low = np.packbits(((values[:, None] >> np.arange(self.width)) & 1).astype(np.uint8), bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.high])])  # ones before each byte

    def __getitem__(self, i: int) -> int:
        byte = int(np.searchsorted(self.before, i, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        place = byte * 8 + int(bits[i - self.before[byte]])
        at, low = i * self.width, 0
        for k in range(self.width):
            low |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return (place - i) << self.width | low


def line_ends(text: str) -> EliasFano:
    """Offsets after the lines ``[^\\n]*\\n|[^\\n]+``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return EliasFano(ends, len(points))


def cut(text: str, ends: EliasFano, seed: int, name: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, str]:
    """Form, code points of prefix and middle, and the transformed text of one row."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return "plain", None, None, text
    a, b = sorted((h[0] % (ends.n + 1), h[1] % (ends.n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: Column | str, form: Column | str) -> Column:
    """The text from the transformed one: no part contains a mark."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "|".join(MARKS))
    joined = lambda *at: F.concat(*[F.element_at(parts, i) for i in at])
    return F.when(form == "psm", joined(2, 4, 3)).when(form == "spm", joined(3, 4, 2)).otherwise(output)


def _shared_texts(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Hashes of texts with many rows, and into how many groups their rows are dealt. One
    pre-aggregated count a hash; fewer than ``SPREAD`` of them reach the driver."""
    counts = docs.select(F.xxhash64(whole(text_col)).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    total = docs.count()
    most = max(LEAST, total // SPREAD)
    return {r["_h"]: -(-r["_n"] // most) for r in counts.where(F.col("_n") > most).collect()}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, a row per input row: number
    of lines, ``psm``, ``spm`` or ``plain``, sizes of the parts and the transformed text."""
    shared = _shared_texts(docs, text_col)

    def deal(batches):
        from pyspark import TaskContext

        turn, seen = {h: TaskContext.get().partitionId() for h in shared}, set()
        for b in by_bytes(batches):
            keys, salts, texts = [], [], b.column(2).to_pylist()
            for i, (h, t) in enumerate(zip(b.column(3).to_pylist(), texts, strict=True)):
                salt = 0
                if h in shared:
                    salt, turn[h] = turn[h] % shared[h], turn[h] + 1
                key = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
                keys.append(key)
                salts.append(salt)
                if (key, salt) in seen:
                    texts[i] = None
                else:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((key, salt))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(keys, pa.binary()), pa.array(salts, pa.int32())], ["doc_id", "_name", "_text", "_key", "_salt"])

    def cuts(batches):
        key = salt = text = ends = None
        rows, size = [], 0

        def batch():
            cols = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for b in by_bytes(batches):
            kind = b.schema.field(0).type
            for doc_id, name, t, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, s) != (key, salt):
                    key, salt, text, ends = k, s, t, line_ends(t)
                elif t is not None and t != text:
                    raise ValueError(f"two texts share the SHA-256 {k.hex()}")
                rows.append((doc_id, ends.n, *cut(text, ends, seed, name, rate, suffix_first)))
                size += len(text)
                if size > OUT_BYTES or len(rows) >= 4096:
                    yield batch()
                    rows.clear()
                    size = 0
        if rows:
            yield batch()

    kind = dict(docs.dtypes)[id_col]
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), text.alias("_text"), F.xxhash64(text).alias("_h"))
    rows = rows.mapInArrow(deal, f"doc_id {kind}, _name string, _text string, _key binary, _salt int")
    rows = rows.repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", F.col("_text").isNull())
    rows = rows.select("doc_id", "_name", "_text", "_key", "_salt")
    return rows.mapInArrow(cuts, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def op11(spark, sf_dir):
    cut_ = fill_in_middle(documents(spark, sf_dir))
    return cut_.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
