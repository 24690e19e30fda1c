"""Fill-in-the-middle, quality and prefix tries against SQL and brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import common, fim, quality, trie

DOCS = "doc_id long, text string, lang string, source string, _key long, key long, salt long, _text string"
TEXTS = [None, "", "\n", "a", "a\nb", "a\nb\n", "\n\nx\n", "has <S> mark", "é\nß\n\U0001f600x\nend", "x" * 5000 + "\n" + "y" * 7, "<\nP>\n<", *(["same\ntext\n"] * 150)]


def brute_elias(values, universe):
    ef = fim.EliasFano(np.array(values, np.int64), universe)
    return [ef[i] for i in range(ef.n)]


def test_elias_fano():
    r = random.Random(1)
    for n in (0, 1, 2, 9, 200):
        for universe in (n, 3 * n + 1, 1000 * n + 5):
            values = sorted(r.sample(range(universe + 1), n))
            assert brute_elias(values, universe) == values


def test_fill_in_middle_against_sql(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fim, "LEAST", 8)  # the many copies are dealt out
    rows = [(i, t, None, None, 1, 2, 3, "z") for i, t in enumerate(TEXTS)] + [(None, "a\nb", None, None, 1, 2, 3, "z"), (3, "other\nlines", None, None, 1, 2, 3, "z"), (3, "a", None, None, 1, 2, 3, "z")]
    df = spark.createDataFrame(rows, DOCS)
    assert max(fim._shared_texts(df, "text").values()) > 10
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(fim.OP11_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=repr)
    b = sorted(want.select(*sorted(want.columns)).fetchall(), key=repr)
    assert a == b
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    out = fim.fill_in_middle(df)
    assert out.where(F.sha2(fim.restored("output", "form"), 256) == F.sha2("output", 256)).count() == out.where("form = 'plain'").count()
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_rate_and_seed(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc\nd\n") for i in range(400)], "doc_id long, text string")
    none = fim.fill_in_middle(df, rate=0).collect()
    assert {r["form"] for r in none} == {"plain"}
    half = [r["form"] for r in fim.fill_in_middle(df, rate=50).collect()]
    assert 120 < half.count("plain") < 280
    assert fim.fill_in_middle(df, seed=1).select("doc_id", "output").subtract(fim.fill_in_middle(df, seed=2).select("doc_id", "output")).count() > 100


def test_tokens_and_shapes():
    for run in ("word", "word.", "a1_b", "(x)", "***", "Ünïcode!!", "²x", "3.14", "éa"):
        assert quality.tokens(run) == quality._TOKEN.findall(run)
    assert [quality.shape(t) for t in ("ab", "Ab", "AB", "aB", "12", "!", "!!")] == ["<aa>", "<Aa>", "<AA>", "<aA>", "<0>", "<!>", "<!!>"]


def test_pairs_by_brute_force(monkeypatch):
    ids, n = np.random.default_rng(0).integers(0, 7, 50), 7
    got, line = np.zeros(n * n, np.int32), [-1] * quality.WINDOW
    for at in range(0, 50, 13):  # in parts, as a long text is
        line += list(ids[at : at + 13])
        quality.add_pairs(got, np.array(line))
        line = line[-quality.WINDOW :]
    want = np.zeros((n, n), int)
    for i in range(50):
        for j in range(i + 1, min(50, i + 1 + quality.WINDOW)):
            want[ids[i], ids[j]] += 1
    assert (got.reshape(n, n) == want).all()


def test_word_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART", 3)
    texts = ["the cat sat on the mat.", "THE END !!", None, "the cat, the dog; a cat", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    words, got = quality.word_vectors(df, words=5, size=16)
    assert words == sorted(words, key=lambda w: (-sum(quality._TOKEN.findall(t or "").count(w) for t in texts), w))
    names = [*quality.SHAPES, *words]
    place, sign = quality.index_vectors(names, 16)
    own, context = np.zeros((len(names), 16)), np.zeros((len(names), 16))
    for i in range(len(names)):
        for p, s in zip(place[i], sign[i]):
            own[i, p] += s
    for t in texts:
        line = [names.index(w) if w in words else names.index(quality.shape(w)) for w in quality._TOKEN.findall(t or "")]
        for i, a in enumerate(line):
            for j in range(max(0, i - 2), min(len(line), i + 3)):
                if i != j:
                    context[a] += own[line[j]]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, context + own / 2, atol=1e-6)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fitted = quality.learn(docs, labels)
    got = quality.quality(docs, fitted).join(labels, "doc_id").where(quality.is_held_out()).where("quality is not null").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 40 and right >= 0.95 * len(got)
    again = quality.learn(docs.repartition(5), labels)
    assert np.allclose(fitted[1], again[1])
    none = labels.limit(0)
    assert {r["score"] for r in quality.quality(docs, quality.learn(docs, none)).collect()} == {0.0}


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5))
    y = (r.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.Network(5)
    net.fit(x[:200], y[:200], decay=0.0)
    loss = lambda: -np.where(y[200:] == 1, np.log(net.scores(x[200:])), np.log(1 - net.scores(x[200:]))).mean()
    before = loss()
    net.calibrate(x[200:], y[200:])
    assert net.temperature > 1 and loss() < before


@pytest.mark.parametrize("share", [1e-9, 1e-5, 0.25])
def test_samples_at_any_share(spark, share):
    """With a simulated count: a share of 1e-9 of so many keys that some are chosen."""
    n = int(min(4_000_000, 3000 / share))
    keys = spark.range(n).select(F.col("id").alias("k"))
    got = common.hash_sample(keys, "k", share, "s").count()
    assert abs(got - n * share) <= 6 * (n * share) ** 0.5 + 3
    point = F.xxhash64(F.col("k").cast("string"), F.lit("s")).bitwiseAND(F.lit((1 << 63) - 1))
    least = keys.orderBy(point).first()["k"]  # what the smallest share that chooses a key chooses
    share = (keys.where(F.col("k") == least).select(point.alias("p")).first()["p"] + 4096) / 2.0**63
    assert common.hash_sample(keys, "k", share, "s").first()["k"] == least


def brute_trie(rows):
    """Nodes by plain dictionaries."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for t in own.values():
        t.sort()
    whole = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, own.get(c - c % 20, [])
        whole[c] = [(x[2], x[4]) for x in base[:h] + t[h:]]
    nodes: dict = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        children = sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in nodes)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string, x long, depth long, label string"


@pytest.mark.parametrize("shard, least", [(200_000, 64), (3, 64), (5, 2)])
def test_trie_by_brute_force(spark, monkeypatch, shard, least):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "LEAST", least)
    monkeypatch.setattr(trie, "PIECE", 2)
    r = random.Random(5)
    rows = [(c, k, r.choice(["user", "assistant", None]), r.choice(["hi", "a b c", "", None])) for c in [*range(60), 400, 419] for k in range(r.choice([1, 1, 2, 4, 7]))]
    rows += [(100 + i, k, "user", "copy of all") for i in range(40) for k in range(3)]  # one conversation many times
    rows += [(None, 1, "user", "lost"), (7, None, None, "first"), (7, 1, "user", "x"), (7, 1, "user", "x")]
    df = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], CONV)
    got = {tuple(x) for x in trie.prefix_trie(df).collect()}
    assert got == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_louds():
    #      0       1
    #    2   3     4
    #    5
    parent = np.array([-1, -1, 0, 0, 1, 2])
    t = trie.Louds(np.array([1, 1, 2, 2, 2, 3]), parent, np.arange(6))
    assert (t.parents() == parent).all() and list(t.degrees()) == [2, 1, 1, 0, 0, 0]
    assert "".join(map(str, np.unpackbits(t.bits, count=13, bitorder="little"))) == "1101101010000"
    leaves = np.array([0, 0, 0, 1, 1, 1])
    t.roll_up(leaves)
    assert list(leaves) == [2, 1, 1, 1, 1, 1]
