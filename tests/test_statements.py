"""The split reader against a parse of the whole file."""

import random
import re

import pytest
from quadrille.sources import rdf, statements as st
from pyspark.sql import functions as F

LINES = [
    "@prefix e: <http://one/> .", "PREFIX f: <http://two/>", "@base <http://b/> .", "base <http://c/>", "@prefix e: <http://three/> . # again .",
    "e:a.b e:p e:c . # a note . \"\"\" no literal", "<x> e:p 'it. is' , \"q . \\\" .\"@en-GB ;", "  f:q 1.5 , .5 , 2 .", "e:l e:p \"\"\"long . ", " still \\\"\"\" . long", " \"\" and '''", "end.\"\"\" .",
    "e:m e:p '''single . \"\"\" .", "more.''' .", "_:n e:p [ e:q ( 1 2.5 <y> ) ] .", "# only . a remark '''", "", "<a>.<b> e:p <c>.e:x.y e:p true.", "e:bad e:worse .", "e:s e:p e:o", ".", "[] e:p _:n.", "e:u a e:T ; ; e:v e:w.x .",
]


def named(triples):
    """With blank nodes in the order they come, so that their names do not count."""
    seen: dict = {}
    return [tuple(seen.setdefault(x, f"_:{len(seen)}") if x.startswith("_:") else x for x in t) for t in triples]


def whole(text):
    """Statement by statement, each failure on its own."""
    scope, good, bad = {}, [], []
    for k, one in enumerate(st.cut(text)):
        try:
            good += list(rdf.parse_turtle(st.ended(one), scope, blank=f"_:g{k}x"))
        except rdf.TurtleError:
            bad.append(one)
    return good, bad


def some_text(r, n):
    """Lines in any order; long literals mostly closed."""
    out = ["@prefix e: <http://zero/> .", "@prefix f: <http://zwei/> ."]
    while len(out) < n:
        k = r.randrange(len(LINES))
        out += LINES[8:12] if k in range(8, 12) else LINES[12:14] if k in (12, 13) else LINES[6:8] if k in (6, 7) else LINES[19:21] if k in (19, 20) else [LINES[k]]
    return r.choice(["\n", "\r\n"]).join(out) + r.choice(["", "\n", "\ne:last e:p e:o", "\ne:x e:p \"\"\"never closed . \n e:a e:b e:c .\n"])


@pytest.mark.parametrize("seed", range(40))
def test_states_compose(seed):
    """Cut at any line, the ends found from the composed states are those of the whole."""
    r = random.Random(seed)
    text = some_text(r, 40)
    text += "" if text.endswith("\n") else "\n"
    at, ends, state, found, place = 0, [], st.PLAIN, [], 0
    while (m := st._RUN.match(text, at).end()) < len(text) and text[m] == ".":
        at = m + 1
        ends.append(at)
    lines = re.findall(r"[^\n]*\n", text)
    while lines:
        k = r.randrange(1, 4)
        part, lines = "".join(lines[:k]), lines[k:]
        to, first, last = st.scan(part, state)
        inner = st.scan(part[:first], state)
        assert first < 0 or inner[2] == first
        if first >= 0:
            found += [place + first, place + last]
        place, state = place + len(part), to
    assert set(found) <= set(ends) and (not ends or {ends[0], ends[-1]} <= set(found))


def _rows(text, path, r, longest):
    """Lines as the reader gives them, with splits of up to so many lines."""
    lines, block, out = text.removesuffix("\n").split("\n"), 0, []
    while lines:
        k = r.randrange(1, longest + 1)
        out += [(path, block, x) for x in lines[:k]]
        block += sum(len(x) + 1 for x in lines[:k])
        lines = lines[k:]
    return out


@pytest.mark.parametrize("seed, longest, chunk", [(1, 2, 30), (2, 9, 1), (3, 30, 150), (4, 200, 70)])
def test_split_as_whole(spark, seed, longest, chunk):
    r = random.Random(seed)
    want, failures, rows = [], 0, []
    for k in range(3):
        text = some_text(r, 60)
        good, bad = whole(text if text.endswith("\n") else text + "\n")
        want += [(f"f{k}.ttl", *("_" if x.startswith("_:") else x for x in t)) for t in good]
        failures += len(bad)
        rows += _rows(text, f"/d/f{k}.ttl", r, longest)
    got = st.statements(spark.createDataFrame(rows, "path string, block long, value string").coalesce(1), chunk).collect()
    lost = [x for x in got if x["error"]]
    good = [(x["file"], *("_" if y.startswith("_:") else y for y in (x["s"], x["p"], x["o"]))) for x in got if not x["error"]]
    assert sorted(good) == sorted(want) and len(want) > 60
    assert len(lost) == failures
    blank = [{y for x in got if x["file"] == f"f{k}.ttl" and x["s"] for y in (x["s"], x["o"]) if y.startswith("_:")} for k in range(2)]
    assert not blank[0] & blank[1]  # nodes of two files are not one


def test_clean_files_equal_the_whole_parse(spark, tmp_path):
    """The same triples as ``parse_turtle`` gives of the text at once, blank nodes matched."""
    text = "".join(f"@prefix e: <http://n{i // 10}/> .\ne:s{i} e:p _:x{i % 3} , \"\"\"a{i} .\r\n# no remark\n\"\"\"@en ; e:q [ e:r {i}.5 ] . # note .\n" for i in range(60))
    (tmp_path / "a.ttl").write_bytes(text.encode())
    want = list(rdf.parse_turtle(text))
    for chunk in (1, 500):
        rows = rdf.read_statements(spark, str(tmp_path), chunk=chunk)[0].select("s", "p", "o").collect()
        assert len(rows) == len(want) == 240
        shape = lambda ts: sorted(tuple("_" if x.startswith("_:") else x for x in t) for t in ts)
        assert shape(rows) == shape(want)
        links = lambda ts: sorted(sorted(t[0] for t in ts if t[2] == n and not t[0].startswith("_:")) for n in {t[2] for t in ts if t[2].startswith("_:")})
        assert links(want) == links([tuple(x) for x in rows])


def test_splits_of_the_reader(spark, tmp_path):
    text = "@prefix e: <http://e/> .\n" + "".join(f'e:s{i} e:p """long .\n{i} e:a e:b .\n""" , "x" .\n' for i in range(300))
    (tmp_path / "a.ttl").write_text(text)
    was = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in was:
            spark.conf.set(c, "3000")
        good, bad = rdf.read_statements(spark, str(tmp_path), chunk=700)
        rows, n = good.select("s", "p", "o").collect(), spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert n > 3 and bad.count() == 0
    assert sorted(map(tuple, rows)) == sorted(rdf.parse_turtle(text))


def test_redefined_prefixes_in_order(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://one/> .\ne:a e:p e:b .\n@prefix e: <http://two/> .\n@base <http://base/> .\ne:a e:p <r> .\n")
    got = {tuple(r) for r in rdf.read_statements(spark, str(tmp_path), chunk=1)[0].select("s", "p", "o").collect()}
    assert got == {("<http://one/a>", "<http://one/p>", "<http://one/b>"), ("<http://two/a>", "<http://two/p>", "<http://base/r>")}


def test_crlf_costs_one_statement(spark, tmp_path):
    (tmp_path / "a.nt").write_bytes(b"".join(b"<a:%d> <p:p> <o:o> .\r\n" % i for i in range(1000)) + b"<a:b> <c:c .\r\n" + b"<a:1000> <p:p> <o:o> .\r\n")
    good, bad = rdf.read_statements(spark, str(tmp_path), chunk=2000)
    assert good.count() == 1001 and bad.count() == 1


def test_a_literal_without_end(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('<a:a> <p:p> <o:o> .\n<a:b> <p:p> """open\n' + "<a:c> <p:p> <o:o> .\n" * 500)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    got = st.statements(lines, chunk=100, longest=1000).collect()
    assert [r["s"] for r in got if r["error"] is None] == ["<a:a>"] and [r["error"] for r in got if r["error"]] == ["a statement too long to be read"]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("")
    (tmp_path / "b.ttl").write_text("\n# nothing .\n\n")
    good, bad = rdf.read_statements(spark, str(tmp_path))
    assert good.count() == bad.count() == 0


def test_quotes_are_escaped():
    assert [t[2] for t in rdf.parse_turtle("<a:a> <p:p> 'say \"x\"' , \"\"\"two\r\nlines \\\" \"q\" \"\"\" .")] == ['"say \\"x\\""', '"two\\r\\nlines \\" \\"q\\" "']
