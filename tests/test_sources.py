import gzip

import pytest

from quadrille.functions import text as tx
from quadrille.functions.repair import repair_line
from quadrille.operators import stats
from quadrille.sources import catalog, rdf, sinks
from pyspark.sql import functions as F

NT = '# c\n\n<a> <p> <o> .\n<a>\t<p>\t"two words" .\n_:b <p> <o> .\n<a> <p>\n<a> p <o> .\n<a> <p> <o> .\n'


@pytest.fixture
def dump(tmp_path):
    (tmp_path / "x.nt").write_text(NT)
    with gzip.open(tmp_path / "y.nt.gz", "wt") as f:
        f.write("<s> <q> <o> .\n")
    return str(tmp_path)


def counts(df):
    return {r["p"]: r["n"] for r in df.groupBy("p").agg(F.count("*").alias("n")).collect()}


def test_three_ways_to_count(spark, dump):
    assert counts(rdf.predicates(spark, dump)) == {"<p>": 4, "<q>": 1}
    assert counts(rdf.predicates(spark, dump, "second_iri")) == {"<p>": 4, "<o>": 2, "<q>": 1}  # also of lines without a second IRI field
    objects = [r["o"] for r in rdf.read_ntriples(spark, dump).collect()]
    assert '"two words"' in objects
    with pytest.raises(ValueError):
        rdf.predicates(spark, dump, "none")


def test_no_input(spark, tmp_path):
    with pytest.raises(rdf.NoInput):
        rdf.read_ntriples(spark, str(tmp_path))


def test_graph_formats(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix e: <http://e/> .\ne:a e:p e:b , "x"@en ; a e:T .\ne:a e:p e:b .\n[ e:q (1 2.5) ] e:r true .\n')
    (tmp_path / "b.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:T rdf:about="http://e/x"><e:p rdf:resource="http://e/y"/><e:p>v</e:p></e:T></rdf:RDF>')
    (tmp_path / "c.ttl").write_text("unknown:a b")
    good, bad = rdf.read_rdf(spark, str(tmp_path))
    got = {(r["file"], r["p"]) for r in good.collect()}
    assert ("a.ttl", "<http://e/p>") in got and ("b.rdf", f"<{rdf.RDF}type>") in got
    assert [r["file"] for r in bad.collect()] == ["c.ttl"]
    assert counts(rdf.predicates(spark, str(tmp_path), "graph"))["<http://e/p>"] == 4


def test_bad_files_cost_themselves_only(spark, tmp_path):
    (tmp_path / "good.ttl").write_text("@prefix e: <http://e/> .\ne:a e:p e:b .\n")
    (tmp_path / "cut.ttl").write_text("@prefix")
    (tmp_path / "z.nt.gz").write_bytes(gzip.compress(b"<a:a> <p:p> <o:o> .\n" * 999)[:-20])
    good, bad = rdf.read_rdf(spark, str(tmp_path))
    assert {r["file"] for r in good.collect()} == {"good.ttl"} and {r["file"] for r in bad.collect()} == {"cut.ttl", "z.nt.gz"}


def test_statements_in_chunks(spark, tmp_path):
    """Any chunk size gives the same triples; a failure costs its statement."""
    body = "".join(f"e:s{i} e:p [ e:q {i} ] ,\n  \"x . y\" .\n" for i in range(40))
    (tmp_path / "a.n3").write_text("@prefix e: <http://e/> .\n# a remark.\n" + body + "e:bad e:worse .\ne:last a e:T .")
    runs = []
    for chunk in (1, 90, 100_000):
        good, bad = rdf.read_statements(spark, str(tmp_path), chunk=chunk)
        rows = good.collect()
        assert len(rows) == 121 and len({r["s"] for r in rows}) == 81 and [r["chunk"] for r in bad.collect()] == ["e:bad e:worse"]
        runs.append(sorted((r["p"], r["o"]) for r in rows if not r["o"].startswith("_:")))
    assert runs[0] == runs[1] == runs[2]
    out = str(tmp_path / "out")
    assert rdf.convert_n3(spark, str(tmp_path), out).count() == 1
    assert rdf.read_ntriples(spark, out, glob="*.txt").count() == 121


def test_index_files(spark, tmp_path):
    t = spark.createDataFrame([("e", 1)], "endpoint string, n int")
    sinks.write_index({"terms": t, "postings": t}, str(tmp_path))
    with pytest.raises(sinks.MissingIndex):
        sinks.read_index(spark, str(tmp_path))
    (tmp_path / "meta.csv").write_text("endpoint,n\ne,1\n")
    assert set(sinks.read_index(spark, str(tmp_path))) == {"meta", "terms", "postings"}


def test_predicate_documents(spark, tmp_path):
    for name, doc in {
        "a": '{"endpoints": [{"id": "x", "predicates": [{"iri": "http://e/p", "usage_count": "bad"}]}, {"id": "y", "predicates": [{"iri": "http://e/q", "usage_count": 3, "local_name": "Q"}, {"iri": " "}]}]}',
        "b": '{"id": "z", "predicates": ["http://e/r"]}',
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "predicates.json").write_text(doc)
    rows = catalog.predicate_records(spark, str(tmp_path / "a"), "y").collect()
    assert [tuple(r) for r in rows] == [("y", "http://e/q", "Q", 3)]
    assert [tuple(r) for r in catalog.predicate_records(spark, str(tmp_path / "b")).collect()] == [("z", "http://e/r", "r", 0)]
    assert catalog.predicate_records(spark, str(tmp_path / "a"), "none").first()["usage_count"] == 0
    assert catalog.discover_endpoints(spark, str(tmp_path)) == ["a", "b"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "predicates.json").write_text('{"other": 1}')
    with pytest.raises(catalog.UnknownShape):
        catalog.predicate_records(spark, str(tmp_path / "c"))


def test_catalog_queries_gold(spark, tmp_path):
    (tmp_path / "e.yml").write_text("endpoints:\n- id: a\n  url: http://a\n- name: http://b\n- id: c\n")
    assert [tuple(r) for r in catalog.read_endpoints(spark, str(tmp_path / "e.yml")).collect()] == [("a", "http://a"), ("http://b", "http://b")]
    (tmp_path / "q.tex").write_text("SELECT * WHERE { ?s gen:a ?o }")
    assert tuple(catalog.read_queries(spark, str(tmp_path)).first()) == ("q", "SELECT * WHERE { ?s gen:a ?o }")
    (tmp_path / "g.json").write_text('{"_note": "x", "$s": "y", "gen:a": "http://e/a"}')
    assert [tuple(r) for r in catalog.read_gold(spark, str(tmp_path / "g.json")).collect()] == [("gen:a", "http://e/a")]


def test_sinks(spark, dump, tmp_path):
    c = stats.predicate_counts(rdf.predicates(spark, dump))
    sinks.write_frequencies(c, str(tmp_path / "f"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()] == ["4\t<p>", "1\t<q>"]
    sinks.write_ndjson(c, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    doc = sinks.predicate_document(c, "x").first()[0]
    assert '"url":null' in doc and doc.index('"p"') < doc.index('"q"')
    sinks.write_ntriples(rdf.read_ntriples(spark, dump), str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 5


def test_functions(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(tx.local_name(F.lit("<http://e/a#b>"))) == "b" and row(tx.local_name(F.lit("http://e/"))) == ""
    assert row(tx.label_tokens(F.lit("http://e/x#partOf_the-Thing%20x"))) == "part of the thing x"
    assert row(tx.label_tokens(F.lit("a/b-c"), split_hyphen=False)) == "b-c"
    assert row(tx.bare_iri(F.lit(" <x> "))) == "x" and row(tx.bare_iri(F.lit(None).cast("string"))) == ""
    assert row(tx.bracketed_iri(F.lit("< a b>"))) == "<ab>"
    assert row(tx.word_ngrams(tx.words(F.lit("One two three")))) == ["one", "two", "three", "one two", "two three", "one two three"]
    assert row(tx.word_ngrams(tx.words(F.lit("x")))) == []
    assert row(tx.strip_accents(F.lit("café"))) == "cafe"
    fix = lambda s: row(repair_line(F.lit(s)))
    assert fix("<<http://bio2rdf.org/a>> <p> <o;> .") == "<http://bio2rdf.org/a> <p> <o> ."
    assert fix("http://bio2rdf.org/a <p> <o> .") == "<http://bio2rdf.org/a> <p> <o> ."
    assert fix("<http://bio2rdf.org/a b'c> <p> <o> .") == "<http://bio2rdf.org/a%20b%27c> <p> <o> ."


def test_stream(spark, dump, tmp_path):
    from quadrille.streaming import predicate_stream

    q = predicate_stream(spark, dump).writeStream.outputMode("complete").format("memory").queryName("uses").start()
    q.processAllAvailable()
    q.stop()
    assert {r["predicate"]: r["usage_count"] for r in spark.table("uses").collect()} == {"<p>": 4, "<q>": 1}
