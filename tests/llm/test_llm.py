"""Training-data operators on small tables, against brute force and odd input."""

import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, counts, exact, fingerprints, language, licenses, links, mixing, neardup, pieces_dropout, queries, toxicity
from quadrille.llm.common import shared_folder
from quadrille.llm.pieces import MARK, MODEL, Vocabulary

ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "a b  c", None, "a"), (4, "a b\tc", "en", "b"), (5, "x", "de", "b"), (5, "x", "de", "b"), (None, "a b c", "en", "a"), (7, "wort " * 20_000, "de", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    names = "n key rid label size _key _gone _id _drop _n _h _src _at _copy __key _rows _times comp th target _COPY2"
    return df.selectExpr("*", *[f"{k} as {x}" for k, x in enumerate(names.split())])  # clashing names


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def proto():
    with open(MODEL, "rb") as f:
        return f.read()


@pytest.mark.parametrize("op", [exact.exact_dedup, mixing.mix, fingerprints.fingerprints, counts.token_counts, pieces_dropout.encode_documents, licenses.license_scan, neardup.near_duplicates])
def test_odd_input(op, odd, empty):
    assert op(odd).count() == len(ODD)
    assert op(empty).count() == 0


QUERIES = {**queries.QUERIES, "pipeline": None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_and_odd_tables(spark, odd, empty, tmp_path, name):
    import corpus_pipeline

    for kind, docs in (("empty", empty), ("odd", odd)):
        d = str(tmp_path / kind)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0, 1), (None, 1, None)][: 2 * (kind == "odd")], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, 0, "user", "hi"), (None, None, None, None)][: 2 * (kind == "odd")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        got = (QUERIES[name] or corpus_pipeline.run)(spark, d).collect()
        if kind == "empty":
            assert got == []
        elif name not in ("op1_spot_signatures", "op3_chat_formatting", "op13_prefix_trie", "pipeline"):
            assert len(got) == len(ODD)
        else:
            assert got


@pytest.mark.parametrize("stage", [exact.drop_copies, language.keep_identified, neardup.drop_near_copies, mixing.mixed_documents])
def test_stages_keep_columns(odd, empty, stage):
    for docs in (odd, empty):
        assert stage(docs).columns == docs.columns
        stage(docs).collect()


def test_stored_parts_go(spark, odd):
    from quadrille.llm import common

    with common.temporary(spark):
        inner = common.stored(odd, "scope")
        lasting = common.stored(odd, "scope", lasting=True)
        neardup.drop_near_copies(odd).collect()
        mine = list(common._BINS[-1])
    assert len(mine) == 2 and lasting.count() == len(ODD)  # the stage's last part, and the scope's own
    with pytest.raises(Exception):
        inner.count()


def test_slices_of_batches():
    import pyarrow as pa

    from quadrille.llm.common import by_bytes

    b = pa.RecordBatch.from_pydict({"x": ["a" * 1000] * 1000})
    parts = list(by_bytes([b], 100_000))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.nbytes for p in parts) < 120_000
    assert max(p.num_rows for p in by_bytes([b])) == 256


def test_exact(odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_dedup(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (None, 3, 3), (5, 5, 2), (7, 7, 1)} == got
    assert sorted(r["doc_id"] for r in exact.drop_copies(odd).collect()) == [1, 3, 5, 7]


def test_targets():
    sizes = {"a": 10, "b": 10, "c": 1000, None: 20}
    t = mixing.targets(sizes)
    assert t["a"] == 30 and t["b"] == 30 and t[None] == 60 and math.isclose(sum(t.values()), 1040)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    for s in {"a", "b", None}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 20
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert mixing.mixed_documents(df).columns == df.columns


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "other"), (5, None, None, None), (5, None, None, None), (None, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [1, 4, 5] and got[1]["copies"] == 2 and got[5]["n_turns"] == 1
    turns = ["zeta", "alpha", "mid", "beta"]
    tied = spark.createDataFrame([(1, 0, "user", t) for t in turns], "conv_id long, turn long, role string, text string")
    order = sorted(turns, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert chat.format_chats(tied).first()["rendered"] == "".join(f"<|user|>\n{t}\n<|end|>\n" for t in order)
    assert got[1]["rendered"] == "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n"


def brute_signatures(text):
    words = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
    content = [w for w in words if w not in fingerprints.ANCHORS]
    out, k = set(), 0
    for w in words:
        if w in fingerprints.ANCHORS:
            if k + 2 <= len(content):
                out.add((w, content[k], content[k + 1]))
        else:
            k += 1
    return out or ({tuple(words)} if words else set())


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of red blue green and dog cat was in".split()) for _ in range(rng.randrange(0, 40))) for _ in range(40)] + ["", "?!", "solo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        assert len(got[i]["signatures"]) == len(brute_signatures(t)) == len(got[i]["fingerprint"]) // 8


def test_fingerprint_likeness_by_brute_force(spark, tmp_path):
    """Also where one id lies far away: no range holds the table."""
    rng = random.Random(12)
    pool = "the of red blue green and dog cat was in with tall old".split()
    texts = {i if i < 599 else 10**15: " ".join(rng.choices(pool, k=rng.randrange(0, 60))) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op1(spark, str(tmp_path)).collect()}
    order = sorted(texts, reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert math.isclose(got[d]["near_edited"], like(brute_signatures(t), brute_signatures(edited)), abs_tol=1e-9)
        assert math.isclose(got[d]["near_next"], like(brute_signatures(t), brute_signatures(nxt)), abs_tol=1e-9)
    same = {}
    for d in texts:
        assert same.setdefault(texts[d], got[d]["fingerprint"]) == got[d]["fingerprint"]
    ranges = df.groupBy(fingerprints._ranges(df.where("doc_id >= 0"))).count().collect()
    assert max(r["count"] for r in ranges) <= 2 * fingerprints.RANGE and len(ranges) > 1


def test_spot_groups_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: set(r["signatures"]) for r in fingerprints.fingerprints(d).collect()}
    group = {i: i for i in rows}
    pairs = [(a, b) for a in rows for b in rows if a < b and rows[a] and len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])]
    for _ in range(9):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {r["doc_id"]: r["group_id"] for r in fingerprints.near_groups(d).collect()} == group and pairs


def test_neighbours(spark, tmp_path):
    texts = {9: "the red dog ran", 4: "an old cat sat é", 1: None, 30: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op1(spark, str(tmp_path)).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 2
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[d]["n_chars"] == len(t)


def test_spot_groups(spark):
    base = "the red dog and a blue cat was in old green house of my tall uncle with some nice trees for rainy days " * 1
    rows = [(1, base), (2, base), (3, base + "today"), (4, "an other text of wholly new words in here")]
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("words_, small", [(2, 16), (5, 16), (2, 0), (1, 1000)])
def test_near(spark, words_, small):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(3, 160))
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 12) + 1)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", None, "one", "ONE", "one"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(words_, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=words_, small=small).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_signatures_within_the_distance_share_a_key(spark):
    """Any two, also those that differ as evenly over the chunks as can be."""
    assert neardup.DISTANCE < 2 * neardup.CHUNKS and sum(neardup._SIZES) == neardup.SYMBOLS
    rng = np.random.default_rng(1)
    rows, differ = [], []
    starts = np.cumsum([0, *neardup._SIZES])
    for k in range(30):
        x = rng.integers(0, 1 << neardup.BITS, neardup.SYMBOLS).astype(np.uint32)
        y = x.copy()
        at = rng.permutation(neardup.SYMBOLS)[: neardup.DISTANCE] if k % 2 else np.array([int(starts[c]) + j for j in range(2) for c in range(neardup.CHUNKS)])[: neardup.DISTANCE]
        y[at] ^= rng.integers(1, 1 << neardup.BITS, len(at)).astype(np.uint32)
        differ.append(int((x != y).sum()))
        rows += [(2 * k, neardup.pack(x[None])[0].tolist()), (2 * k + 1, neardup.pack(y[None])[0].tolist())]
    classes = spark.createDataFrame(rows, "rid long, sig array<long>")
    shared = neardup.keys(classes).groupBy("key").agg(F.collect_set("rid").alias("r")).where("size(r) > 1").collect()
    assert {tuple(sorted(r["r"])) for r in shared} >= {(2 * k, 2 * k + 1) for k in range(30)}
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(30)], "a long, b long")
    assert {(r["a"], r["d"]) for r in neardup.close(pairs, classes).collect()} == {(2 * k, differ[k]) for k in range(30)}


def test_signatures_estimate_likeness():
    """Differing symbols of sets at the threshold stay within the distance."""
    rng, family = np.random.default_rng(2), neardup._family()
    d = []
    for _ in range(300):
        items = rng.integers(0, 1 << 63, 225).astype(np.uint64)
        x, y = np.unique(items[:200]), np.unique(np.concatenate([items[:177], items[200:222]]))  # about 0.8
        d.append(int((neardup.signature(x, family) != neardup.signature(y, family)).sum()))
    assert 17 < np.mean(d) < 22 and max(d) <= neardup.DISTANCE


@pytest.mark.parametrize("few", [0, 7, 10**6])
def test_components(spark, few):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    group = {x: x for e in edges for x in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["rid"]: r["label"] for r in links.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert {x: got.get(x, x) for x in group} == group


def test_token_counts_by_brute_force(proto):
    v = Vocabulary(proto)
    logp = counts.log_probabilities(v)

    def best(t):
        if not t:
            return [(0.0, 0)]
        out = []
        for i in range(1, len(t) + 1):
            p = logp.get(t[:i])
            if p is not None:
                out += [(s + p, n + 1) for s, n in best(t[i:])]
        b = len(t[0].encode())
        return out + [(s + counts.BYTE * b, n + b) for s, n in best(t[1:])]

    trie = counts.ForwardTrie(logp)
    for t in (MARK + "hello", MARK + "thethe", MARK + "日x", "ab", MARK):
        top = max(s for s, _ in best(t))
        assert trie.count(t) in {n for s, n in best(t) if math.isclose(s, top)}


def test_long_pre_tokens(proto):
    logp = counts.log_probabilities(Vocabulary(proto))
    trie, deep = counts.ForwardTrie(logp), MARK + "internationalisationé" * 40
    assert len(deep) > counts.DEEP and trie.count(deep) == trie._windowed(deep)
    for t in (MARK + "hello", MARK + "thethe", "ab日"):
        assert trie.count(t) == trie._windowed(t)
    counts.DEEP, was = 10**9, counts.DEEP
    try:
        assert trie.count(deep) == trie._windowed(deep)
    finally:
        counts.DEEP = was


def test_pieces(proto):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    plain, dropped = pieces_dropout.Codec(proto, 0.0), pieces_dropout.Codec(proto, 0.3, 5)
    for t in ("hello world", "  a  b ", "\n\nx", "日本語 テスト", "", " ", "Éa, un été.\tx"):
        assert plain.encode(t) == sp.encode(t)
        for c in (plain, dropped):
            assert c.decode(c.encode(t)) == t
    texts = [f"{MARK}a{MARK} b", "a﷐b ﷐", "", "\0", "x" * 500]
    flat, ends = dropped.encode_flat(texts, [3] * len(texts))
    assert [x.decode() for x in dropped.decode_flat(flat, ends)] == texts
    for t in texts:
        assert dropped.decode(dropped.encode(t)) == t
    rng = random.Random(4)
    for _ in range(200):
        w = MARK + "".join(rng.choice("theanderqué") for _ in range(rng.randrange(1, 40)))
        assert dropped.many([w], 1)[0] == dropped._ids(dropped.long(w, 1)) and plain.many([w], 0)[0] == plain._ids(plain.long(w, 0))
    long = "internationalisation of tokenisation " * 5
    assert dropped.encode(long) != plain.encode(long)
    assert dropped.encode(long) == pieces_dropout.Codec(proto, 0.3, 5).encode(long) != pieces_dropout.Codec(proto, 0.3, 6).encode(long)


def test_decode_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = pieces_dropout.decode_documents(pieces_dropout.encode_documents(df))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b", 2: ""}


def test_equal_words_are_split_on_their_own(spark, proto):
    """Between documents, within one, and between copies; the same in every run, and as
    the scalar merges have it."""
    text = "internationalisation unquestionably " * 20
    rows = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 1), (None, text, 1)], "doc_id long, text string, copy int")
    runs = [{(r["doc_id"], tuple(r["ids"])) for r in pieces_dropout.encode_documents(rows.repartition(n), copy_col="copy").collect()} for n in (1, 3)]
    assert len({ids for _, ids in runs[0]}) == 4 and runs[0] == runs[1]
    c = pieces_dropout.Codec(proto)
    units = c._split(text + "x" * 60 + " ﷐")
    assert len({c._long(w, int(k)).__str__() for w, k in zip(units, c._keys(7, len(units)), strict=True) if w == units[2]}) > 1
    apart = [i for w, k in zip(units, c._keys(7, len(units)), strict=True) for i in (c._ids(c._long(w, int(k))) if w else [c.v.byte[b] for b in '﷐'.encode()])]
    assert c.encode(text + "x" * 60 + " ﷐", 7) == apart


def test_copies_of_the_mix_are_numbered(spark):
    rows = [(i, "w " * 40, "en", "b" if i else "a") for i in range(40)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA), copy_col="copy").collect()
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got) > len({r["doc_id"] for r in got})


def test_forward_by_brute_force():
    p = {"a": (0.2, 0.1), "b": (0.1, 0.3), "ab": (0.3, 0.05), "ba": (0.05, 0.2), MARK + "a": (0.1, 0.2)}

    def total(w, k):
        return 1.0 if not w else sum(p[w[:i]][k] * total(w[i:], k) for i in range(1, len(w) + 1) if w[:i] in p)

    f = language.Forward(p, 2)
    for w in ("a", "ab", "abba", "babab"):
        assert all(math.isclose(x, math.log(total(w, k))) for k, x in enumerate(f.score(w)))
    assert all(-5000 < x < 0 for x in f.score("ab" * 1000))
    words = ["a", "ab", "abba", "babab", "axb", "x" * 64, "ab" * 32, "ab" * 500, "日本b", "b"]
    assert np.allclose(f.many(words), [f.score(w) for w in words], rtol=1e-12)
    s = language.Scorer(p, 2)
    assert np.allclose(s.texts([["a", "ab"], [], ["ab"] * 5]), [np.add(s.forward.score(MARK + "a"), s.forward.score(MARK + "ab")), [0, 0], np.multiply(5, s.forward.score(MARK + "ab"))])
    uses = language.expected("ab", {"a": 0.2, "b": 0.1, "ab": 0.3}, 2)
    assert math.isclose(uses["ab"], 0.3 / 0.32)


def test_language(spark, odd, empty):
    d = "/root/testdata/sf0.001"
    rows = [r for r in language.op7(spark, d).collect()]
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = [r for r in rows if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    fitted = language.learn(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, fitted).collect()}
    assert got[1] == got[2] == "und"
    assert language.identify(empty, language.learn(empty)).count() == 0


def brute_matches(words):
    """The grammar's rules, word by word, of (class, weight)."""
    out, aimed = [], set()
    ended = lambda j, k: any(words[m][0] == "y" and words[m - 1][0] == "n" for m in range(j + 1, k))
    negated = lambda k: any(words[j][0] == "n" and not ended(j, k) for j in range(max(0, k - 3), k))
    for k, (c, _) in enumerate(words):
        told = toxicity.REPORTED if any(x == "r" for x, _ in words[:k]) else 1.0
        if c == "i":
            x = words[k][1] * told * (toxicity.NEGATED if negated(k) else 1) * (toxicity.AIMED if any(x == "t" for x, _ in words[max(0, k - 4) : k]) else 1)
            out.append([x, k])
        if c == "t":
            last = {own: max((j for j in range(k) if words[j][0] == own), default=-9) for own in "ih"}
            if k - last["i"] <= 3 and last["i"] not in aimed:
                aimed.add(last["i"])
                [m for m in out if m[1] == last["i"]][0][0] += words[last["i"]][1] * told * (toxicity.NEGATED if negated(last["i"]) else 1) * toxicity.AIMED_AFTER
            if k - last["h"] <= 3 and last["h"] not in aimed:
                aimed.add(last["h"])
                out.append([toxicity.THREAT_WEIGHT * told * (toxicity.NEGATED if negated(last["h"]) else 1), -1])
    return sorted(x for x, _ in out)


def test_composition_by_brute_force():
    rng, g = random.Random(8), toxicity.Grammar({})
    for _ in range(3000):
        words = [(c, rng.choice([1.0, 2.0]) if c == "i" else 0.0) for c in rng.choices("nyrthio", [2, 2, 1, 3, 2, 3, 5], k=rng.randrange(1, 14))]
        assert np.allclose(sorted(g.matches(words)), brute_matches(words)), words


def test_toxicity(spark, odd, empty):
    g = toxicity.Grammar({"idiot": 2.0})
    hit, negated, only, reported, aimed, behind, plural = (g.clauses(t)[0] for t in ("such idiot", "not an idiot", "not only an idiot", "he said idiot", "you idiot", "idiot you are", "such idiots"))
    assert negated < hit == only == plural < behind and hit < aimed and reported < aimed and g.clauses("fine day") == []
    assert g.clauses("kill the process") == [] and g.clauses("to kill, not hurt") == [] and g.clauses("i will kill you") == [toxicity.THREAT_WEIGHT]
    assert g.clauses("they said i will kill you")[0] < toxicity.THREAT_WEIGHT
    no = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(odd, toxicity.learn(odd, no)).collect()} == {0}
    assert toxicity.toxicity(empty, toxicity.learn(empty, no)).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert toxicity.learn(odd, one)[0] == {}


def test_licenses():
    known, first = licenses._tables(licenses.SENTENCES, licenses.RULES)
    apache = '\n'.join(licenses.SENTENCES[k] for k in ("apache-grant", "apache-use", "apache-copy", "apache-law"))
    assert [x for x, _, _ in licenses.scan(apache, known, first)] == ["Apache-2.0"]
    assert [x for x, _, _ in licenses.scan("Bla. Released under the MIT License. Licensed under CC BY-NC 4.0.", known, first)] == ["MIT", "CC-BY-NC-4.0"]
    assert licenses.scan("the MIT license is short", known, first) == []
    bsd = ' '.join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert [x for x, _, _ in licenses.scan(bsd, known, first)] == ["BSD-2-Clause"]


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize("text, name", [(MIT, "MIT"), (GPL, "GPL-3.0"), (BSD, "BSD-2-Clause"), (BSD + BSD_NAME, "BSD-3-Clause")])
def test_licenses_as_published(text, name):
    known, first = licenses._tables(licenses.SENTENCES, licenses.RULES)
    one_line = text.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")
    comment = "".join(f" * {line}".rstrip() + "\n" for line in text.split("\n"))
    marks = re.sub(r"(?m)^(\d)\.", r"(\1)", text)
    for t in (text, one_line, comment, marks, text.replace("\n", "\r\n"), text.replace(" ", "  " * 50), "Some heading\n" + text):
        assert [x for x, _, _ in licenses.scan(t, known, first)] == [name]


def test_licenses_by_brute_force():
    """Sentences in any order: at each place the longest rule whose sentences follow."""
    rng = random.Random(9)
    known, first = licenses._tables(licenses.SENTENCES, licenses.RULES)
    names = sorted({n for _, ids in licenses.RULES for n in ids})
    for _ in range(300):
        ids = []
        while len(ids) < 9:
            ids += list(rng.choice(licenses.RULES)[1]) if rng.random() < 0.5 else [rng.choice([*names, None, None])]
        text = "\n\n".join(licenses.SENTENCES[n] if n else "Some words of no license." for n in ids)
        # sentences cut in two by a colon or full stop inside them are not in play here
        want, k = [], 0
        while k < len(ids):
            best = None
            for name, rule in licenses.RULES:
                j, place = 0, k
                at = []
                while j < len(rule) and place < len(ids) and (ids[place] == rule[j] or ids[place] is None and j):
                    if ids[place] is not None:
                        at.append(place)
                        j += 1
                    place += 1
                most = 0 if rule[0] == "spdx" else licenses.GAP
                if j == len(rule) and all(b - a - 1 <= most for a, b in zip(at, at[1:])) and (best is None or len(rule) > len(best[1])):
                    best = (name, at)
            if best:
                want.append((best[0], best[1][0], best[1][-1]))
                k = best[1][-1] + 1
            else:
                k += 1
        assert licenses.scan(text, known, first) == want, ids


@pytest.mark.parametrize("text, name", [("// SPDX-License-Identifier: MIT\ncode();", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"), (GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0")])
def test_more_licenses(text, name):
    known, first = licenses._tables(licenses.SENTENCES, licenses.RULES)
    assert [x for x, _, _ in licenses.scan(text, known, first)] == [name]
    assert licenses.scan("MIT. Some BSD-3-Clause.", known, first) == []


def test_licenses_on_lines_of_their_own():
    known, first = licenses._tables(licenses.SENTENCES, licenses.RULES)
    assert licenses.scan("no stop here\nReleased under the MIT License\nnor here", known, first) == [("MIT", 1, 1)]
    assert licenses.scan("One. Two:\nthree\nLicensed under CC BY 4.0.", known, first) == [("CC-BY-4.0", 3, 3)]
    assert licenses.scan("it is not released under the MIT License.", known, first) == []


@pytest.mark.parametrize("shared", [None, 5])
def test_stages_decide_by_row(spark, shared):
    """One row with the id ``shared`` goes, the others with that id and texts of their
    own stay; of rows that repeat id and text, exact keeps one."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 300 and lang = 'en'").orderBy("doc_id").limit(4)
    a, b, c, _ = [" ".join(dict.fromkeys(r["text"].split())) for r in d.collect()]
    docs = lambda *rows: spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA)
    left = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    want = sorted([(1, a), (shared or 0, b), (shared or 0, c)])
    assert left(exact.drop_copies(docs((1, a), (shared, a), (shared, b), (shared, c), (shared, c)))) == want
    assert left(language.keep_identified(docs((1, a), (shared, "123"), (shared, b), (shared, c)))) == want
    near = a.replace(a.split()[5], "edited", 1)
    if shared:  # null ids are never near copies
        assert left(neardup.drop_near_copies(docs((1, a), (shared, near), (shared, b), (7, c)))) == sorted([(1, a), (shared, b), (7, c)])
        again = b.replace(b.split()[5], "edited", 1)
        assert len(left(neardup.drop_near_copies(docs((shared, b), (shared, again), (shared, c))))) == 2


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(texts) == before > 100
    parts = lambda: {p.name for p in (Path(shared_folder(spark).removeprefix("file://")) / "quadrille").glob("*")}
    were = parts()
    out = corpus_pipeline.run(spark, d).collect()
    assert [x.split("-")[:2] for x in parts() - were] == [["pipeline", "mixing"]]  # what the result reads
    assert {r["doc_id"] for r in out} <= set(texts) and all(r["lossless"] for r in out)
    back = {(r["doc_id"], r["text"]) for r in pieces_dropout.decode_documents(spark.createDataFrame(out)).collect()}
    assert back <= set(texts.items())
    # against brute force: words of each source against its target
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    want = mixing.targets({s: sum(size(texts[i]) for i in texts if source[i] == s) for s in set(source.values())})
    for s, target in want.items():
        most = max(size(texts[i]) for i in texts if source[i] == s)
        assert abs(sum(size(texts[r["doc_id"]]) for r in out if source[r["doc_id"]] == s) - target) <= most + 0.02 * target


@pytest.mark.parametrize("cell", [2, 1024])
def test_rarest_items_lose_no_pair_at_the_threshold(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    r = random.Random(5)
    sets = {}
    for i in range(120):  # near copies of a few sets, many of them about the threshold
        base = range(1000 * (i % 4), 1000 * (i % 4) + 10 + 15 * (i % 3))
        sets[i] = sorted({x if r.random() > 0.1 else r.randrange(10**6) for x in base})
    rows = spark.createDataFrame([(i, s) for i, s in sets.items()], "rid long, items array<long>")
    got = [(x["a"], x["b"]) for x in neardup.by_rarest(rows.selectExpr("rid", "rid as comp", "cast(size(items) as long) n", "explode(items) item"), 0.8).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert want and want <= {tuple(sorted(p)) for p in got} and len(got) == len(set(got))


def test_an_item_that_all_members_hold_makes_no_pairs_below_the_threshold(spark):
    """Seven shared items and one own: a likeness of 0.78. Pairs of all members would be
    1,250 million. A few shorter sets lie within the shared ones and meet all."""
    n, short = 50_000, 3
    rows = spark.range(n).selectExpr("id as rid", "concat(sequence(1L, 7L), array(1000 + id)) as items")
    got = lambda rows: neardup.by_rarest(rows.selectExpr("rid", "rid as comp", "cast(size(items) as long) n", "explode(items) item"), 0.8)
    assert got(rows).count() == 0
    few = rows.where("rid < 4000").unionByName(spark.range(n, n + short).selectExpr("id as rid", "sequence(1L, 7L) as items"))
    met = {(r["a"], r["b"]) for r in got(few).collect()}
    assert {(a, n + b) for a in range(4000) for b in range(short)} <= met and all(b >= n for _, b in met)
