"""MinHash near-duplicates by a multi-index Hamming join.

A text's set: distinct shingles of ``words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased);
with fewer words, the whole sequence as one; without words or text, empty and linked with
nothing. A signature has ``SYMBOLS`` minhashes of ``BITS`` bits. Signatures of sets at the
threshold differ in ``DISTANCE`` symbols or fewer (the mean plus 4 standard deviations).
Split into more than ``DISTANCE / 2`` chunks, such signatures agree but for one symbol in
some chunk: every chunk is looked up under each way to leave one symbol out, which finds
all pairs within the distance. Candidates are confirmed on whole texts.

Equal sets are one class. Inside a bucket of equal keys each member meets the smallest
one; links confirmed on whole texts form components, a member's nearest star first. Then
only buckets with several components are looked at again: in buckets of ``SMALL`` members
or fewer the members of different components meet, in larger ones those that share one
of their rarest shingles. So a group of n near copies costs about n confirmations, and no
link between components is lost.

Rows with a null id are linked with nothing. Rows that repeat an id stay, each with the
component of its text. An empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, documents, free, kept, stored, temporary, text_key, whole, without
from .links import components

THRESHOLD = 0.8
#: Words of a shingle, unless the caller says otherwise.
WORDS = 5
SYMBOLS, BITS, DISTANCE = 96, 10, 35
CHUNKS = 18
#: Members of a bucket up to which components meet in pairs.
SMALL = 16
#: Members of a cell that one task pairs with another cell.
CELL = 1024
#: Bits of the filter that texts pass before they are shuffled (4 MB).
FILTER = 1 << 25
#: Word hashes remembered by a worker: bounds memory, not results.
REMEMBERED = 200_000
_SIZES = [len(x) for x in np.array_split(np.arange(SYMBOLS), CHUNKS)]
assert DISTANCE // CHUNKS == 1 and max(_SIZES) * BITS < 64
_FIELD = (1 << BITS) - 1
#: The lowest bit of each symbol of a chunk.
_ONES = sum(1 << (BITS * j) for j in range(max(_SIZES)))
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, hashes: _Hashes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    x = h[: len(h) - n + 1] * _K1
    for k in range(1, n):
        x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * _K2 + h[k : len(h) - n + 1 + k] * _K1
    x ^= x >> np.uint64(33)
    x *= _K3
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _family(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, (SYMBOLS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, (SYMBOLS, 1)).astype(np.uint32)


def signature(items: np.ndarray, family) -> np.ndarray:
    a, b = family
    low, best = (items >> np.uint64(32)).astype(np.uint32)[None, :], None
    for at in range(0, low.shape[1], 2048):
        least = (low[:, at : at + 2048] * a + b).min(axis=1)
        best = least if best is None else np.minimum(best, least)
    return (best * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def pack(signatures: np.ndarray) -> np.ndarray:
    """Rows of ``SYMBOLS`` symbols to rows of ``CHUNKS`` longs."""
    out, at = np.zeros((len(signatures), CHUNKS), np.int64), 0
    for c, n in enumerate(_SIZES):
        for j in range(n):
            out[:, c] |= signatures[:, at + j].astype(np.int64) << (BITS * j)
        at += n
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, keep: tuple = (), words: int = WORDS) -> DataFrame:
    """``doc_id, th, n, sa, sb, sig`` (and ``keep``): a hash of the text, set size, the
    set's 128-bit hash, its signature."""

    def run(batches):
        import xxhash

        hashes, family = kept("hashes", _Hashes), _family()
        for batch in by_bytes(batches):
            sizes, sa, sb, sigs = [], [], [], []
            for text in batch.column(2).to_pylist():
                items = shingle_set(text, hashes, words)
                whole_set = xxhash.xxh3_128_digest(items.tobytes())
                sizes.append(len(items))
                sa.append(int.from_bytes(whole_set[:8], "little", signed=True))
                sb.append(int.from_bytes(whole_set[8:], "little", signed=True))
                sigs.append(signature(items, family) if len(items) else np.zeros(SYMBOLS, np.uint32))
            flat = pack(np.array(sigs, np.uint32).reshape(len(sigs), SYMBOLS)).ravel()
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, CHUNKS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), sig, *batch.columns[3:]], ["doc_id", "th", "n", "sa", "sb", "sig", *keep])

    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("th"), whole(text_col).alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds[id_col]}, th long, n long, sa long, sb long, sig array<long>", *(f"{k} {kinds[k]}" for k in keep)]))


def _maybe(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``rows`` (``doc, th, text``) less most of those not in ``needed``, so that a join
    moves few other texts: a filter of ``FILTER`` bits that the driver passes on. Its size
    is fixed; where it is full, more rows pass, none is lost."""
    slot = F.pmod(F.xxhash64("doc", "th"), F.lit(FILTER))
    words = needed.select(slot.alias("_s")).groupBy(F.expr("_s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(_s % 64 as int)))").alias("v")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for batch in batches:
            s = batch.column(3).to_numpy()
            hit = (bits[s >> 6] >> (s & 63)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["doc", "th", "text"]).filter(pa.array(hit.astype(bool)))

    return rows.withColumn("_s", slot).mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, th long, text string")


def texts_of(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, text`` of the classes in ``needed`` (``rid, doc, th``): one text of each."""
    rows = _maybe(docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("th"), whole(text_col).alias("text")), needed)
    return stored(rows.join(needed, ["doc", "th"]).groupBy("doc", "th").agg(F.first("rid").alias("rid"), F.first("text").alias("text")).select("rid", "text"), "near-texts")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """``a, b`` of the pairs whose sets have intersection >= threshold * union, in whole
    hundredths."""
    t = round(threshold * 100)

    def run(batches):
        hashes = kept("hashes", _Hashes)
        for batch in by_bytes(batches):
            x, y = (map(lambda s: shingle_set(s, hashes, words), batch.column(c).to_pylist()) for c in (2, 3))
            good = []
            for u, v in zip(x, y, strict=True):
                both = len(u) + len(v) - len(np.union1d(u, v))
                good.append(100 * both >= t * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    kinds = dict(pairs.dtypes)
    met = pairs.select("a", "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("y")), "b")
    return stored(met.select("a", "b", "x", "y").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}"), "near-edges")


def items_of(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``rid, comp, n, item``: the set of each member, a row for each item."""

    def run(batches):
        hashes = kept("hashes", _Hashes)
        for batch in by_bytes(batches):
            for k, text in enumerate(batch.column(2).to_pylist()):
                x = shingle_set(text, hashes, words).view(np.int64)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    same = [c.slice(k, 1).take(pa.array(np.zeros(len(part), np.int64))) for c in batch.columns[:2]]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(part), len(x))), pa.array(part)], ["rid", "comp", "n", "item"])

    kinds = dict(members.dtypes)
    return members.select("rid", "comp").join(texts, "rid").mapInArrow(run, f"rid {kinds['rid']}, comp {kinds['comp']}, n long, item long")


def keys(classes: DataFrame) -> DataFrame:
    """``key, rid``: each chunk under each way to leave one of its symbols out."""
    out: list[Column] = []
    for c, n in enumerate(_SIZES):
        for j in range(n):
            rest = sum(_FIELD << (BITS * i) for i in range(n) if i != j)
            out.append(F.xxhash64(F.lit(len(out)), F.col("sig")[c].bitwiseAND(F.lit(rest))))
    return classes.select(F.explode(F.array(*out)).alias("key"), "rid")


def _differing(x: Column, y: Column) -> Column:
    """Symbols in which two longs differ: the bits of each come together in its lowest."""
    v = x.bitwiseXOR(y)
    far = BITS
    while far > 1:
        far = (far + 1) // 2
        v = v.bitwiseOR(F.shiftrightunsigned(v.bitwiseAND(F.lit(_ONES * (_FIELD & ~((1 << far) - 1)))), far))
        v = v.bitwiseAND(F.lit(_ONES * ((1 << far) - 1)))
    return F.bit_count(v)


def distance(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, _differing), F.lit(0), lambda a, b: a + b)


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, d`` of the pairs whose signatures are within the distance."""
    x = classes.select(F.col("rid").alias("a"), F.col("sig").alias("x"))
    y = classes.select(F.col("rid").alias("b"), F.col("sig").alias("y"))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", distance("x", "y").alias("d")).where(f"d <= {DISTANCE}"), "near-close")


def _of(members: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    got = labels.select(F.col("rid").alias(column), F.col("label").alias("_l"))
    return members.join(got, column, "left").withColumn(name, F.coalesce("_l", column)).drop("_l")


def by_rarest(whole_set: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: pairs of members of different components that can reach the threshold, of
    their sets' ``rid, comp, n, item``.

    Items in one order, rarest first: sets at the threshold share an item within the
    first ``n - least overlap + 1`` of each, at places that leave enough items behind.
    Places and sizes are compared by cell, before members meet: an item that many hold
    makes as many pairs as its cells allow, and large cells are dealt to several tasks.
    The edits of near copies are rare, so members too far from all others share none."""
    t = round(threshold * 100)
    often = whole_set.groupBy("item").agg(F.count("*").alias("_f")).where("_f > 1")
    # an item of one set only meets nothing: the rest follow the n - count(*) such items
    common = whole_set.join(often, "item").groupBy("rid", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("_f", "item"))).alias("_o"))
    placed = common.select("rid", "comp", "n", F.posexplode(F.expr(f"slice(_o, 1, greatest(0, n - cast(ceil({t} * n / 100.0) as int) + 1 - (n - size(_o))))")).alias("_p", "_e"), (F.col("n") - F.size("_o")).alias("_alone"))
    placed = stored(placed.select("rid", "comp", "n", F.col("_e.item").alias("item"), (F.col("n") - F.col("_alone") - F.col("_p")).alias("left")), "near-prefix")
    # members with the same item, size and place are a cell: what rules out two cells rules
    # out all their pairs, and no pair is looked at before its cells may meet
    cells = placed.groupBy("item", "n", "left").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    band = F.floor(F.log("n") / F.lit(1e-6 - math.log(threshold)))  # sizes that can meet lie in the same or the next
    x = cells.select("item", *(F.col(c).alias(c + "x") for c in ("n", "left", "f", "lo", "hi")), band.alias("_b"))
    y = cells.select("item", *(F.col(c).alias(c + "y") for c in ("n", "left", "lo", "hi")), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    enough = F.expr(f"100L * nx >= {t}L * ny and 100L * ny >= {t}L * nx and {100 + t}L * least(leftx, lefty) >= {t}L * (nx + ny) and not (lox = hix and lox = loy and loy = hiy)")
    met = stored(x.join(y, ["item", "_b"]).where(enough).select("item", "nx", "leftx", "ny", "lefty", F.ceil(F.col("fx") / CELL).alias("_parts")), "near-cells")
    # a large cell is dealt to several tasks, each of which gets the cells it meets whole
    cell = ["item", "nx", "leftx", "ny", "lefty", "_part"]
    x = placed.select("item", F.col("n").alias("nx"), F.col("left").alias("leftx"), F.col("rid").alias("a"), F.col("comp").alias("_ca"))
    y = placed.select("item", F.col("n").alias("ny"), F.col("left").alias("lefty"), F.col("rid").alias("b"), F.col("comp").alias("_cb"))
    x = x.join(met, ["item", "nx", "leftx"]).withColumn("_part", F.pmod(F.xxhash64("a"), "_parts")).drop("_parts")
    y = y.join(met, ["item", "ny", "lefty"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return x.join(y, cell).where("a < b and _ca <> _cb").select("a", "b").distinct()


def _between(members: DataFrame, labels: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Of buckets with several components: pairs of members of different components in
    the small ones (``a, b``), and the members of the others (``rid, comp``)."""
    named = stored(_of(members.where("n > 2"), labels, "rid", "comp").select("key", "rid", "rep", "n", "comp"), "near-named")
    several = named.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key")
    mixed = stored(named.join(several, "key", "left_semi"), "near-mixed")
    x, y = (mixed.where(f"n <= {small} and rid <> rep").select("key", F.col("rid").alias(r), F.col("comp").alias(c)) for r, c in (("a", "_ca"), ("b", "_cb")))
    pairs = x.join(y, "key").where("a < b and _ca <> _cb").select("a", "b").distinct()
    return pairs, stored(mixed.where(f"n > {small}").select("rid", "comp").distinct(), "near-large")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple = (), words: int = WORDS, small: int = SMALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` (and ``keep``), a row per input row."""
    with temporary(docs.sparkSession):
        rows = stored(sketch(docs, id_col, text_col, keep, words), "near-rows", lasting=True)
        linked = rows.where("n > 0 and doc_id is not null")
        classes = linked.groupBy("sa", "sb").agg(F.min(F.struct("doc_id", "th")).alias("_least"), F.first("sig").alias("sig"))
        classes = stored(classes.select("sa", "sb", F.col("_least.doc_id").alias("doc"), F.col("_least.th").alias("th"), "sig"), "near-classes")
        # a class goes by its smallest id, unless ids are repeated with different sets
        repeated = classes.groupBy("doc").count().where("count > 1").limit(1).count() > 0
        classes = classes.withColumn("rid", F.concat_ws("/", F.col("doc").cast("string"), "sa", "sb") if repeated else F.col("doc"))
        every = keys(classes)
        shared = stored(every.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("rep")).where("n > 1"), "near-keys")
        members = stored(every.join(shared, "key"), "near-members")
        fetch = lambda rids: texts_of(docs, stored(classes.select("rid", "doc", "th").join(rids.distinct(), "rid", "left_semi"), "near-needed"), id_col, text_col)
        ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rid"))

        # the nearest star of each member first, then those still between components
        stars = close(members.where("rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b")).distinct(), classes)
        texts = fetch(ends(stars))
        edges = confirm(stars.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")), texts, threshold, words)
        labels = components(edges)
        apart = _of(_of(stars, labels, "a", "_ca"), labels, "b", "_cb").where("_ca <> _cb").select("a", "b")
        edges = edges.unionByName(confirm(apart, texts, threshold, words))
        labels = components(edges)

        pairs, large = _between(members, labels, small)
        late = close(pairs, classes)
        texts = texts.unionByName(fetch(ends(late).unionByName(large.select("rid")).join(texts.select("rid"), "rid", "left_anti")))
        if not large.isEmpty():
            late = late.unionByName(close(by_rarest(stored(items_of(large, texts, words), "near-items"), threshold), classes))
        if not late.isEmpty():
            labels = components(edges.unionByName(confirm(late.select("a", "b").distinct(), texts, threshold, words)))

        of = _of(classes.select("sa", "sb", "rid", "doc"), labels, "rid", "comp")
        if repeated:
            least = of.groupBy("comp").agg(F.min(F.struct("doc", "rid")).alias("_least"))
            of = of.join(least, "comp").select("sa", "sb", F.col("_least.doc").alias("component_id"), (F.col("rid") == F.col("_least.rid")).alias("_first"))
        else:
            of = of.select("sa", "sb", F.col("comp").alias("component_id"), F.lit(True).alias("_first"))
        of = stored(of, "near-of", lasting=True)
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("_first"), *keep)
    out = linked.join(of, ["sa", "sb"]).select("doc_id", "n", "component_id", "_first", *keep).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("_first")).alias("kept"), *keep)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all columns; sets are
    of ``WORDS`` words."""
    key = free(docs, "key")
    keyed = docs.withColumn(key, text_key())
    with temporary(docs.sparkSession):
        gone = stored(near_duplicates(keyed, keep=(key,)).where("not kept").select("doc_id", key).distinct(), "near-gone", lasting=True)
    return without(keyed, gone, key).select(docs.columns)


def op8(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=2)
