"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult (a lexicon of whole words with learned weights), threat,
target, negation, "only", report, other. Five transducers - negation, reported speech,
target, insult, threat - are composed into one table over their joint states. Run over a
clause it emits matches, each weighed by the states it is met in:

- an insult matches where it stands: more with a target up to four words before or three
  after it, less within three words after a negation ("not only" is none);
- a threat verb matches only with a target up to three words after it, else not at all;
- after a word of reported speech all matches of the clause count less.

A clause scores its strongest match and a part of the others; clauses without a match
score nothing. A logistic curve over the clauses' scores gives the probability. Word
weights and the curve are fitted on a bounded sample (about ``SAMPLE`` labelled rows, never
held-out ones); only ``LEXICON`` words and as many feature rows as the sample has reach
the driver. Without both labels in the sample the score is the share of toxic rows, or 0.
Null text counts as empty and gets the score of a text without a match. An empty table
gives an empty result; rows that repeat are scored each; rows labelled twice count once
with their larger label. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, hash_sample, held_out, kept, whole

SAMPLE, LEXICON = 6_000, 4_000
#: A word needs so many toxic texts and so much log odds.
SUPPORT, LEAST_ODDS = 5, 1.5
THRESHOLD = 0.3

# word classes of the grammar, in the languages at hand
NEGATION = frozenset("not no never none nobody neither nor without cannot nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca ningún ninguna sin".split())
ONLY = frozenset("only just merely nur bloß seulement solo sólo solamente".split())
REPORT = frozenset("said says claimed wrote quoted quote called calls reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
TARGET = frozenset("you your yours yourself u he she they him her them du dich dir dein ihr euch sie tu toi te vous ton usted ustedes tú ti".split())
THREAT = frozenset("kill hurt destroy murder beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())

#: Weight of a threat, and factors of the states in which a match is met.
THREAT_WEIGHT, NEGATED, REPORTED, AIMED, AIMED_AFTER = 3.0, 0.3, 0.6, 1.2, 0.4
#: Words after a negation, after a target, and until a target, that still belong together.
NEAR_NEGATION, NEAR_TARGET, UNTIL_TARGET = 3, 4, 3
#: Part of a clause's further matches.
FURTHER = 0.25

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = {w: c for c, words in (("n", NEGATION), ("y", ONLY), ("r", REPORT), ("t", TARGET), ("h", THREAT)) for w in words}


# Transducers: state x class -> next state; what they emit is read off their states.
def _negation(s: int, c: str) -> int:
    """Words for which the last negation still holds; right after it "only" ends it."""
    return NEAR_NEGATION if c == "n" else 0 if c == "y" and s == NEAR_NEGATION else max(0, s - 1)


def _report(s: int, c: str) -> int:
    return 1 if c == "r" else s


def _target(s: int, c: str) -> int:
    return NEAR_TARGET if c == "t" else max(0, s - 1)


def _until(own: str):
    """Words in which a target can still complete the last ``own``; 0 once it has."""
    return lambda s, c: UNTIL_TARGET if c == own else 0 if c == "t" else max(0, s - 1)


_insult, _threat = _until("i"), _until("h")


def compose() -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float, float, float]]:
    """The product of the transducers: next state, and the factors of an insult met here,
    of the insult that a target here completes, of the threat that it completes. The
    last state holds whether the pending threat or insult was negated."""
    table = {}
    spans = (range(NEAR_NEGATION + 1), range(2), range(NEAR_TARGET + 1), range(UNTIL_TARGET + 1), range(UNTIL_TARGET + 1), range(2), range(2))
    for n, r, t, i, h, ni, nh in product(*spans):
        for c in "nyrthio":
            told = REPORTED if r else 1.0
            here = told * (NEGATED if n else 1.0) * (AIMED if t else 1.0) if c == "i" else 0.0
            after = told * (NEGATED if ni else 1.0) * AIMED_AFTER if c == "t" and i else 0.0
            threat = told * (NEGATED if nh else 1.0) if c == "t" and h else 0.0
            then = (_negation(n, c), _report(r, c), _target(t, c), _insult(i, c), _threat(h, c), int(n > 0) if c == "i" else ni, int(n > 0) if c == "h" else nh)
            table[(n, r, t, i, h, ni, nh), c] = then, here, after, threat
    return table


START = (0,) * 7


class Grammar:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.table, self.known = lexicon, compose(), {}

    def word(self, word: str) -> tuple[str, float]:
        """Class and weight of a word; a plural counts as its singular."""
        own = _CLASSES.get(word)
        if own:
            return own, 0.0
        x = self.lexicon.get(word) or (self.lexicon.get(word[:-1]) if word.endswith("s") else None)
        return ("i", x) if x else ("o", 0.0)

    def matches(self, words: list[tuple[str, float]]) -> list[float]:
        """Weights of the matches in a clause of classes."""
        state, out, last, table = START, [], 0.0, self.table
        for c, x in words:
            state, here, after, threat = table[state, c]
            if here:
                out.append(x * here)
                last = x
            if after:
                out[-1] += last * after  # the last match is that insult: threats wait for targets
            if threat:
                out.append(THREAT_WEIGHT * threat)
        return out

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses in which the grammar matches."""
        out, known = [], self.known
        for clause in _CLAUSE.split(text.lower()):
            words = []
            for w in _WORD.findall(clause):
                x = known.get(w)
                if x is None:
                    if len(known) >= 300_000:
                        known.clear()
                    x = known[w] = self.word(w)
                words.append(x)
            if not any(c in "ih" for c, _ in words):
                continue
            met = sorted(self.matches(words), reverse=True)
            if met:
                out.append(met[0] + FURTHER * sum(met[1:]))
        return out


def _grammar(lexicon: tuple[tuple[str, float], ...]) -> Grammar:
    """A worker's grammar, kept from task to task."""
    return kept(("grammar", lexicon), lambda: Grammar(dict(lexicon)))


def features(scores: list[float]) -> list[float]:
    return [1.0, math.log1p(sum(scores)), math.log1p(max(scores, default=0.0)), math.log1p(len(scores))]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Word weights and the curve's coefficients."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return {}, [-30.0, 0.0, 0.0, 0.0]
    picked = hash_sample(known, "doc_id", sample / n, "toxic")  # bounded by the sample
    rows = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(picked), "doc_id").select("toxic", "text")

    def uses(batches):
        """Per word, texts by label; equal words of a text count once."""
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_pylist([{"word": w, "y": int(y), "n": k} for (w, y), k in total.items()])

        for b in by_bytes(batches):
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in set(_WORD.findall(text.lower())):
                    total[w, y] += 1
            if len(total) > 500_000:
                yield rows()
                total.clear()
        if total:
            yield rows()

    share = picked.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    pos, neg = int(share["t"] or 0), int(share["n"] - (share["t"] or 0))
    if not pos or not neg:
        p = min(max(pos / max(1, pos + neg), 1e-9), 1 - 1e-9)
        return {}, [math.log(p / (1 - p)), 0.0, 0.0, 0.0]
    found = rows.mapInArrow(uses, "word string, y long, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("q") + 2.0) / (neg + 1.0))
    best = found.where(F.col("p") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.log1p("p")), "word").limit(LEXICON)
    weights = {r["word"]: float(r["odds"]) for r in best.collect() if r["word"] not in _CLASSES}

    def clauses(batches):
        g = _grammar(tuple(weights.items()))
        for b in by_bytes(batches):
            x = [features(g.clauses(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    seen = rows.mapInArrow(clauses, "y int, x array<double>").collect()  # a row per sampled text
    w = fit_curve(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float))
    return weights, [float(v) for v in w]


def toxicity(docs: DataFrame, fitted: tuple[dict[str, float], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, n_clauses`` (clauses with a match), a row per input row."""
    weights, curve = fitted

    def run(batches):
        g = _grammar(tuple(weights.items()))
        for b in by_bytes(batches):
            found = [g.clauses(t) for t in b.column(1).to_pylist()]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * x for a, x in zip(curve, features(f), strict=True)))))) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(map(len, found), pa.int64())], ["doc_id", "score", "predicted", "n_clauses"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_clauses long")


def op5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fitted = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, fitted).select("doc_id", held_out().alias("held_out"), "score", "predicted")
