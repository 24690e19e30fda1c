"""The data source against whole parses; RDF/XML node by node."""

import gzip

import pytest
from quadrille.sources import datasource, rdf

HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/doc" xml:lang="en">'


@pytest.fixture
def source(spark):
    datasource.register(spark)
    return lambda path, **options: spark.read.format("rdf").options(**options).load(str(path))


def test_ranges_of_lines(spark, source, tmp_path):
    text = "".join(f"<s:{i}> <p:{i % 7}> \"é {i}\" .\r\n" for i in range(500)) + "# end\n<bad\n"
    (tmp_path / "a.nt").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.nt.gz", "wt") as f:
        f.write("<s:x> <p:1> _:n .\n")
    for size in (997, 4000, 10**6):
        df = source(tmp_path, splitBytes=str(size))
        assert df.count() == 501
    assert {r["o"] for r in df.where("file = 'a.nt'").collect()} == {f'"é {i}"' for i in range(500)}
    few = df.where("p = '<p:1>'")
    assert few.count() == 73 and few.where("file = 'a.nt'").count() == 72  # the gzip file has one more
    assert df.where("p in ('<p:1>', '<p:2>') and s = '<s:1>'").count() == 1
    bad = source(tmp_path, rows="failures").collect()
    assert [(r["file"], r["chunk"]) for r in bad] == [("a.nt", "<bad")]


def test_the_reader_gets_the_filter():
    r = datasource.RdfReader({})
    left = list(r.pushFilters([datasource.EqualTo(("p",), "<p:1>"), datasource.EqualTo(("s",), "x"), datasource.In(("p",), ("<p:1>", "<p:2>"))]))
    assert r.wanted == {"<p:1>"} and len(left) == 1


def test_pushed_predicates_leave_the_plan(spark, source, tmp_path):
    (tmp_path / "a.nt").write_text("<s:1> <p:1> <o:1> .\n")
    plan = source(tmp_path).where("p = '<p:1>' and s = '<s:1>'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "s:1" in plan.split("BatchScan")[0] and "p:1" not in plan.split("BatchScan")[0].replace("isnotnull", "")


def test_streamed_turtle(spark, source, tmp_path, monkeypatch):
    text = "@prefix e: <http://e/> .\n" + "".join(f'e:s{i} e:p """a .\né {i}""" ; e:q e:o.{i} .\n' for i in range(200)) + "e:bad e:worse .\n@prefix e: <http://f/> .\ne:last e:p e:o"
    (tmp_path / "a.ttl").write_text(text)
    rows = source(tmp_path).collect()
    assert len(rows) == 401 and ("<http://f/last>", "<http://f/p>", "<http://f/o>") in {tuple(r)[1:] for r in rows}
    assert [r["chunk"] for r in source(tmp_path, rows="failures").collect()] == ["e:bad e:worse"]
    with open(tmp_path / "a.ttl", "rb") as f:
        monkeypatch.setattr(datasource, "BLOCK", 50)  # cut within characters and literals
        small = [t for t, e in datasource._streamed(f, {"blank": "_:g", "label": "_:".__add__}) if t]
    assert sorted(small) == sorted(tuple(r)[1:] for r in rows)


def test_rdfxml(spark, source, tmp_path):
    body = (
        '<e:T rdf:about="x" e:name="N"><e:p rdf:resource="#y"/><e:q>v "q"</e:q><e:n rdf:datatype="http://t">1</e:n><e:r xml:lang="de">w</e:r></e:T>'
        '<rdf:Description rdf:nodeID="n"><e:p rdf:parseType="Resource"><e:q xml:lang="">z</e:q></e:p></rdf:Description>'
        '<rdf:Description rdf:ID="i"><e:p rdf:nodeID="n"/><e:l rdf:parseType="Collection"><e:T rdf:about="http://a"/><e:T rdf:about="http://c"/></e:l></rdf:Description>'
        '<rdf:Bag rdf:about="http://bag"><rdf:li>one</rdf:li><rdf:li rdf:resource="http://two"/></rdf:Bag><e:U xml:base="http://other/" rdf:about="#z"><e:p e:k="v"/></e:U>'
    )
    (tmp_path / "a.rdf").write_text(HEAD + body + "</rdf:RDF>")
    got = {tuple(r)[1:] for r in source(tmp_path).collect()}
    e, t = "<http://e/{}>".format, f"<{rdf.RDF}type>"
    for want in (
        ("<http://b/x>", t, e("T")), ("<http://b/x>", e("name"), '"N"@en'), ("<http://b/x>", e("p"), "<http://b/doc#y>"), ("<http://b/x>", e("q"), '"v \\"q\\""@en'), ("<http://b/x>", e("n"), '"1"^^<http://t>'),
        ("<http://b/x>", e("r"), '"w"@de'), ("<http://bag>", f"<{rdf.RDF}_2>", "<http://two>"), ("<http://bag>", f"<{rdf.RDF}_1>", '"one"@en'), ("<http://other/#z>", t, e("U")),
    ):
        assert want in got, want
    named = [s for s, p, o in got if (p, o[:2]) == (e("p"), "_:") and s.startswith("_:")]
    assert len(named) == 1 and ("<http://b/doc#i>", e("p"), named[0]) in got and any(o == '"z"' for _, _, o in got)
    assert len(got) == len(list(rdf.parse_rdfxml(HEAD + body + "</rdf:RDF>"))) == 22


def test_large_rdfxml_is_streamed(tmp_path):
    """Nodes are dropped as they are read."""

    class Stream:
        def __init__(self, n):
            self.parts, self.left = iter([HEAD.encode(), *(b'<rdf:Description rdf:about="http://s"><e:p>%d</e:p></rdf:Description>' % i for i in range(n)), b"</rdf:RDF>"]), n

        def read(self, size=-1):
            return next(self.parts, b"")

    import tracemalloc

    tracemalloc.start()
    assert sum(1 for _ in rdf.rdfxml_nodes(Stream(30_000))) == 30_000
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
