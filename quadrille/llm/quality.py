"""Quality classifier: random-indexing word vectors, pooled, through a two-layer network.

Tokens are runs of letters, digits, marks. The ``WORDS`` most used tokens of all documents
have vectors of their own; the others share one for their shape (case, digits, marks). A
token's index vector has a few entries of +1 and -1, placed by a hash of the token; its
context vector is the sum of the index vectors of its neighbours up to ``WINDOW`` tokens
away, in all documents. These sums are whole numbers, so every run gives the same. A word
vector is the normalised context vector and index vector side by side in one sum; a
document's is the mean of its tokens', with shares of what repeats.

A network of two layers is fitted in numpy on about ``SAMPLE`` labelled rows (chosen by a
hash, never held-out ones, a bound of the model); a fifth of them is kept to fit the
temperature that divides its output. Without both labels in the sample the score is the
share of label 1, or 0 without labels.

Null text counts as empty and is scored as a text without tokens. An empty table gives an
empty result; repeated rows are scored each; rows labelled twice count once with their
larger label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, hash_sample, kept, stored, temporary, whole

SAMPLE = 6_000
WORDS, SIZE, ENTRIES, WINDOW = 4_096, 64, 4, 2
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.01, 1e-3
THRESHOLD = 0.3
#: Tokens remembered by a worker and tokens pooled at a time: bound memory, not results.
REMEMBERED, PART = 300_000, 200_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MARKS = frozenset(".,;:!?")
SHAPES = ("<aa>", "<Aa>", "<AA>", "<aA>", "<0>", "<!>", "<!!>")


def tokens(run: str) -> list[str]:
    """Tokens of a run without white space; words with or without a mark at the end, the
    most of all, need no pattern."""
    if run.isalpha():
        return [run]
    if run[-1:] in MARKS and run[:-1].isalpha():
        return [run[:-1], run[-1]]
    return _TOKEN.findall(run)


def shape(token: str) -> str:
    if token[0].isalpha():
        if token.islower():
            return "<aa>"
        if token.isupper() and len(token) > 1:
            return "<AA>"
        return "<Aa>" if token[1:].islower() or len(token) == 1 else "<aA>"
    return "<0>" if token[0].isdigit() else "<!>" if len(token) == 1 else "<!!>"


class Ids(dict):
    """Of a run without white space, the numbers of its tokens: their own, else their
    shape's."""

    def __init__(self, words: list[str]):
        self.own = {w: i for i, w in enumerate([*SHAPES, *words])}

    def __missing__(self, run: str) -> tuple[int, ...]:
        own = self.own
        ids = tuple(own[t] if t in own else own[shape(t)] for t in tokens(run))
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = ids
        return ids

    def of(self, runs: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, runs)))


def index_vectors(words: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's entries."""
    place, sign = np.zeros((len(words), ENTRIES), np.int64), np.zeros((len(words), ENTRIES), np.int64)
    for i, w in enumerate(words):
        h = np.frombuffer(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4 * ENTRIES).digest(), np.uint32)
        place[i], sign[i] = (h >> 1) % size, 1 - 2 * (h & 1).astype(np.int64)
    return place, sign


def add_pairs(pairs: np.ndarray, ids: np.ndarray) -> None:
    """Counts in the flat square ``pairs`` how often a token stands up to ``WINDOW`` before
    another. An id of -1 stands between texts; the first ``WINDOW`` ids only come before."""
    n = math.isqrt(pairs.size)
    for off in range(1, WINDOW + 1):
        a, b = ids[WINDOW - off : -off], ids[WINDOW:]
        both = (a >= 0) & (b >= 0)
        np.add.at(pairs, a[both] * n + b[both], np.int32(1))


def vocabulary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[str]:
    """The most used tokens of all texts, ties by token."""

    def uses(batches):
        total: Counter = Counter()  # of runs without white space, cut into tokens once each

        def rows():
            words: Counter = Counter()
            for run, n in total.items():
                for w in tokens(run):
                    words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in by_bytes(batches):
            for text in b.column(0).to_pylist():
                total.update(text.split())
                if len(total) > REMEMBERED:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    found = docs.select(whole(text_col).alias("text")).mapInArrow(uses, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with temporary(docs.sparkSession):
        found = stored(found.withColumn("_size", F.floor(F.log2("n") * 8)), "quality-words")
        # sizes from which on there are enough words: so few rows meet in the last step
        sizes, seen, least = found.groupBy("_size").count().orderBy(F.desc("_size")).collect(), 0, 0
        for r in sizes:  # less than 512 rows
            seen, least = seen + r["count"], r["_size"]
            if seen >= words:
                break
        return [r["word"] for r in found.where(F.col("_size") >= least).orderBy(F.desc("n"), "word").limit(words).collect()]


def word_vectors(docs: DataFrame, text_col: str = "text", words: int = WORDS, size: int = SIZE) -> tuple[list[str], np.ndarray]:
    """The vocabulary and the vectors of shapes and words, in that order. Every task sends
    one row a word; words x size numbers reach the driver."""
    known = vocabulary(docs, text_col, words)
    place, sign = index_vectors([*SHAPES, *known], size)
    cols = [f"c{i}" for i in range(size)]

    def contexts(batches):
        ids, pairs = Ids(known), np.zeros(len(place) ** 2, np.int32)
        for b in by_bytes(batches):
            line = [-1] * WINDOW
            for text in b.column(0).to_pylist():
                runs = text.split()
                for at in range(0, len(runs), PART):
                    line.extend(ids.of(runs[at : at + PART]))
                    if len(line) >= PART:
                        add_pairs(pairs, np.array(line))
                        line = line[-WINDOW:]
                line.extend([-1] * WINDOW)
            add_pairs(pairs, np.array(line))
        own = np.zeros((len(place), size))
        np.add.at(own, (np.arange(len(place))[:, None], place), sign)
        square = pairs.reshape(len(place), -1)
        table = np.zeros((len(place), size))
        for at in range(0, len(place), 512):
            some = square[at : at + 512].astype(float)
            table[at : at + 512] += some @ own
            table += some.T @ own[at : at + 512]
        table = table.astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, i]) for i in range(size))], ["word", *cols])

    got = docs.select(whole(text_col).alias("text")).mapInArrow(contexts, "word long, " + ", ".join(f"{c} long" for c in cols))
    summed = got.groupBy("word").agg(*[F.sum(c).alias(c) for c in cols]).select("word", F.array(*cols).alias("v"))
    context = np.zeros((len(place), size))
    for r in summed.collect():
        context[r["word"]] = r["v"]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = np.zeros_like(context)
    np.add.at(own, (np.arange(len(place))[:, None], place), sign)
    return known, (context + own / np.sqrt(ENTRIES)).astype(np.float32)


def pooled(texts: list[str], ids: Ids, vectors: np.ndarray) -> np.ndarray:
    """A row per text: the mean vector of its tokens, and three shares of the whole text:
    lines that repeat, words that repeat, lines without a full stop at their end."""
    out = np.zeros((len(texts), vectors.shape[1] + 3))
    for row, text in zip(out, texts, strict=True):
        runs, n = text.split(), 0
        for at in range(0, len(runs), PART):
            found = ids.of(runs[at : at + PART])
            row[:-3] += vectors[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if runs:
            row[:-3] /= max(1, n)
            lines = [x for x in text.split("\n") if x.strip()]
            row[-3:] = 1 - len(set(lines)) / len(lines), 1 - len(set(runs)) / len(runs), sum(not x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines)
    return out


class Network:
    """``softmax``-free binary network: standardised input, tanh layer, logistic output."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 12):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0
        self.p = [r.normal(0, 1 / np.sqrt(size), (size, hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> None:
        """Adam on the cross entropy of all rows."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            w1, b1, w2, b2 = self.p
            h = np.tanh(z @ w1 + b1)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y) / len(y)
            back = d[:, None] * w2 * (1 - h * h)
            for i, g in enumerate((z.T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, d.sum(keepdims=True))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross entropy on rows that were not fitted."""
        z, grid = self.logits(x), np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def is_held_out(doc_id: str = "doc_id"):
    """Remainder 0 of crc32(doc_id as text) mod 5. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, Network | float]:
    """Vocabulary, word vectors, and the network or the one score of all texts."""
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return [], np.zeros((len(SHAPES), SIZE), np.float32), 0.0
    picked = F.broadcast(hash_sample(known, "doc_id", sample / n, "quality"))  # bounded by the sample
    words, vectors = word_vectors(docs)

    def pool(batches):
        ids = Ids(words)
        for b in by_bytes(batches):
            x = pooled(b.column(2).to_pylist(), ids, vectors)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "fold", "x"])

    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("temperature")), F.lit(5)).cast("int")
    rows = docs.join(picked.withColumnRenamed("quality", "_y"), "doc_id").select("_y", fold.alias("fold"), whole(docs["text"]).alias("text"))
    got = rows.mapInArrow(pool, "y int, fold int, x array<double>").collect()  # a row per sampled text
    got.sort(key=lambda r: (r["fold"], r["y"], r["x"]))
    y = np.array([r["y"] for r in got], float)
    if not 0 < y.sum() < len(y):
        return words, vectors, float(y.mean()) if len(y) else 0.0
    x, later = np.array([r["x"] for r in got]), np.array([r["fold"] == 0 for r in got])
    if later.sum() < 20 or not 0 < y[~later].sum() < (~later).sum():
        later = np.zeros(len(y), bool)
    net = Network(x.shape[1])
    net.fit(x[~later], y[~later])
    if later.any():
        net.calibrate(x[later], y[later])
    return words, vectors, net


def quality(docs: DataFrame, fitted: tuple[list[str], np.ndarray, Network | float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, a row per input row; no shuffle."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(fitted)  # vocabulary x size numbers

    def run(batches):
        words, vectors, net = shared.value
        ids = kept(("quality", name), lambda: Ids(words))
        for b in by_bytes(batches):
            texts = b.column(1).to_pylist()
            score = net.scores(pooled(texts, ids, vectors)) if isinstance(net, Network) else np.full(len(texts), net)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op12(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fitted = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, fitted).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
