import pytest
from quadrille.engine import Engine, MissingCatalog, Settings, generic_uses
from quadrille.operators import evaluation, index, search, selection
from pyspark.sql import functions as F
from quadrille.plans.execute import execute
from quadrille.plans.rewrite import normalise_mapping, rewrite
from quadrille.plans.sparql import QuerySyntaxError, Triple, generic_triples, generics, parse, show, walk

UNION = "SELECT ?v WHERE { { ?s gen:a ?r . ?r gen:b ?v } UNION { ?u gen:a ?r . ?r gen:b 'x' } }"
URLS = {"one": "http://one/", "two": "http://two/"}
CHOSEN = {"gen:a": {"one": "http://p/a"}, "gen:b": {"one": {"uri": "http://p/b"}}}


def test_round_trip():
    for q in (UNION, 'PREFIX e: <http://e/>\nSELECT DISTINCT * WHERE { ?s a e:T ; e:p "x"@en, 3 . FILTER (?x > 3 && REGEX(?y, "a", "i")) OPTIONAL { ?s e:q ?z } } ORDER BY DESC(?s) LIMIT 5 OFFSET 2'):
        assert show(parse(show(parse(q)))) == show(parse(q))
    for q in ("ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o . } WHERE { ?s ?p ?o }", "DESCRIBE ?s WHERE { ?s ?p ?o }"):
        assert show(parse(q)).startswith(q.split(" {")[0].split(" WHERE")[0])
    with pytest.raises(QuerySyntaxError):
        parse("INSERT { ?s ?p ?o }")


CORPUS = {
    "star": "PREFIX e: <http://e/>\nSELECT ?s ?n WHERE { ?s gen:partOf e:x ; gen:name ?n , \"x\"@en . }",
    "chain": "SELECT DISTINCT ?a ?c WHERE { ?a gen:partOf ?b . ?b gen:partOf ?c . ?c a <http://e/T> } ORDER BY DESC(?c) ?a LIMIT 10",
    "optional": "SELECT * WHERE { ?s gen:a ?o . OPTIONAL { ?o gen:b ?x . OPTIONAL { ?x gen:c ?y } } ?s gen:d ?z }",
    "union": UNION,
    "filters": "SELECT ?s WHERE { ?s gen:a ?o ; gen:b ?p . FILTER (REGEX(STR(?o), \"a.b\", \"i\") && ?p >= 3.5 || !BOUND(?p)) FILTER (?o != <http://e/x>) }",
    "nested": "SELECT ?s WHERE { { ?s gen:a ?o . { ?o gen:b ?p } } UNION { ?s gen:c ?o . FILTER (?o = \"y\") } UNION { ?o gen:d ?s } }",
    "service": "SELECT * WHERE { SERVICE <http://e/sparql> { ?s <http://p/a> ?o } ?o gen:b ?x . }",
    "blank": "SELECT ?s WHERE { ?s gen:a [] . _:n gen:b ?s . ?s gen:c 3, -1.5e3, true . } OFFSET 2",
    "variable": "SELECT ?p WHERE { <http://e/a> ?p ?o . ?o gen:a \"5\"^^<http://www.w3.org/2001/XMLSchema#integer> }",
    "remarks": "# gen:none of this\nPREFIX e: <http://e / x/>\nSELECT REDUCED * { ?s gen:a e:b.c ; ; gen:b ?o. # end\n }",
    "ranges": "SELECT ?x ?y WHERE { ?x gen:a ?m . ?y gen:b ?n . FILTER (?m <= ?n) FILTER (?n < 10) }",
    "ask": "ASK WHERE { ?s gen:a ?o }",
}


@pytest.mark.parametrize("name", sorted(CORPUS))
def test_corpus(spark, name):
    """Each query is read, rewritten without loss and planned."""
    text = CORPUS[name]
    q = parse(text)
    names = generics(text)
    chosen = {n: {"e": f"http://p/{n[4:]}"} for n in names}
    out = rewrite(text, chosen, {"e": "http://e/sparql"})
    assert not [t for t in generic_triples(parse(out)) if t.p in chosen]
    count = lambda q: sum(isinstance(x, Triple) for _, _, x, _ in walk(q.where))
    assert count(parse(out)) == count(q) > 0 and show(parse(out)) == out
    empty = spark.createDataFrame([], "endpoint string, s string, p string, o string")
    assert execute(out, empty, endpoints={"e": "http://e/sparql"}).count() == (name == "ask")


def test_queries_as_rows(spark):
    from quadrille.operators import queries

    df = spark.createDataFrame([*CORPUS.items(), ("broken", "SELECT { "), ("none", None)], "query_id string, text string")
    rows = queries.query_patterns(df).collect()
    assert {r["query_id"] for r in rows if r["error"]} == {"broken", "none"}
    nested = [(r["block"], r["pos"], r["p"]) for r in rows if r["query_id"] == "nested"]
    assert nested == [("/0.0", 0, "gen:a"), ("/0.0/1", 1, "gen:b"), ("/0.1", 2, "gen:c"), ("/0.2", 3, "gen:d")]
    chosen = spark.createDataFrame([("gen:a", "e", "<p:a>"), ("gen:d", "e", "<p:d>"), ("gen:b", "f", "<p:b>")], "generic string, endpoint string, predicate string")
    got = {(r["block"], r["endpoint"]): r["body"] for r in queries.service_blocks(queries.query_patterns(df), chosen).where("query_id = 'optional'").collect()}
    assert got == {("", "e"): "?s <p:a> ?o .\n?s <p:d> ?z .", ("/1", "f"): "?o <p:b> ?x ."}
    assert {r["query_id"] for r in queries.rewritten(df, {}, {}).where("error is not null").collect()} == {"broken", "none"}


def test_index_by_endpoint(spark, tmp_path):
    """Building one endpoint again keeps the others; a run that dies changes nothing."""
    from quadrille.sources import sinks

    path = str(tmp_path / "index")
    table = lambda e, n: {k: spark.createDataFrame([(e, i, k) for i in range(n)], "endpoint string, i int, t string") for k in ("meta", "terms", "postings")}
    counts = lambda: {(k, r["endpoint"]): r["count"] for k, df in sinks.read_index(spark, path).items() for r in df.groupBy("endpoint").count().collect()}
    sinks.write_index(table("a", 2), path)
    sinks.write_index(table("b/ c", 3), path)
    assert counts() == {(k, e): n for k in ("meta", "terms", "postings") for e, n in (("a", 2), ("b/ c", 3))}
    sinks.write_index(table("a", 5), path)
    assert counts()["terms", "a"] == 5 and counts()["terms", "b/ c"] == 3
    assert len(list((tmp_path / "index/terms/endpoint=a").iterdir())) == 1  # what no longer counts is gone
    died = table("a", 7)
    died["postings"] = died["postings"].withColumn("i", F.raise_error(F.lit("died")).cast("int"))
    with pytest.raises(Exception):
        sinks.write_index(died, path)
    assert counts()["terms", "a"] == 5 and {r["endpoint"] for r in sinks.built_endpoints(spark, path).collect()} == {"a", "b/ c"}


def test_prefix_repair():
    assert parse("PREFIX a: <http://x / y>\nSELECT * WHERE { ?s a:b ?o }").prologue == "PREFIX a: <http://x/y>"


def test_generics():
    assert generics("?s gen:a gen:b . x:gen:c gen:a # gen:d") == ["gen:a", "gen:b", "gen:d"]
    assert len(generic_triples(parse(UNION))) == 4


def test_rewrite_keeps_union_branches():
    out = rewrite(UNION, CHOSEN, URLS)
    assert out.count("SERVICE <http://one/>") == 2 and "gen:" not in out
    assert rewrite(UNION, CHOSEN, URLS, compat_grouping=True).count("SERVICE") == 1
    kept = rewrite("SELECT * WHERE { ?s gen:a ?o . ?o gen:zz ?x }", CHOSEN, URLS)
    assert "?o gen:zz ?x ." in kept
    assert "SERVICE" not in rewrite(UNION, {"gen:a": {"unknown": "http://p"}}, URLS)
    assert "SERVICE <http://direct/>" in rewrite(UNION, {"a": {"http://direct/": ["http://p"]}}, {})
    assert normalise_mapping({"selected": {"x": {"e": None, "f": {"p": "q"}}}}) == {"gen:x": ("f", "q")}
    assert normalise_mapping([]) == {}


@pytest.fixture
def quads(spark):
    rows = [("e", "a", "p", "1"), ("e", "a", "q", "x"), ("e", "b", "p", "20"), ("f", "b", "r", "a"), ("f", "c", "r", "b")]
    return spark.createDataFrame(rows, "endpoint string, s string, p string, o string")


def run(quads, q, **k):
    return sorted(tuple(r) for r in execute(q, quads, **k).collect())


def test_execute(quads):
    assert run(quads, "SELECT ?s ?o WHERE { ?s <p> ?o FILTER (?o > 3) }") == [("b", "20")]
    assert {tuple(r) for r in execute("SELECT ?s ?x WHERE { ?s <p> ?o . OPTIONAL { ?s <q> ?x } }", quads).collect()} == {("a", "x"), ("b", None)}
    assert run(quads, "SELECT ?z ?o WHERE { ?z <r> ?y . ?y <p> ?o }") == [("b", "1"), ("c", "20")]
    assert run(quads, "SELECT ?s WHERE { { ?s <q> ?o } UNION { ?s <r> ?o } }") == [("a",), ("b",), ("c",)]
    assert run(quads, "SELECT ?s WHERE { SERVICE <http://f> { ?s ?p ?o } }", endpoints={"f": "http://f"}) == [("b",), ("c",)]
    assert {tuple(r) for r in execute("SELECT ?s ?never WHERE { ?s <q> 'x' }", quads).collect()} == {("a", None)}
    assert execute("ASK { ?s <q> ?o }", quads).first()["answer"] and not execute("ASK { ?s <none> ?o }", quads).first()["answer"]
    # a variable that OPTIONAL left unbound agrees with every value
    got = execute("SELECT ?s ?x ?y WHERE { { ?s <p> ?o . OPTIONAL { ?s <q> ?x } } { ?y <q> ?x } }", quads).collect()
    assert {tuple(r) for r in got} == {("a", "x", "a"), ("b", "x", "a")}
    plan = execute("SELECT ?s ?x ?y WHERE { { ?s <p> ?o . OPTIONAL { ?s <q> ?x } } { ?y <q> ?x . ?y <p> ?o } }", quads)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_named_predicates_read_their_columns_only(spark):
    from quadrille.registry import bgp_chain, bgp_star

    for f, scans in ((bgp_star, 3), (bgp_chain, 5)):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == scans, plan


@pytest.fixture
def engine(spark):
    rows = [("one", "http://p/partOf", "partOf", 5), ("one", "http://p/label", "label", 9), ("two", "http://q/isPartOf", "isPartOf", 1), ("two", "http://q/name", "name", 2)]
    idx = index.build_index(spark.createDataFrame(rows, "endpoint string, predicate string, local_name string, usage_count long"))
    return Engine(spark, idx, URLS)


def test_engine(spark, engine):
    q = "SELECT * WHERE { ?s gen:partOf ?o . ?o gen:name ?n }"
    done = engine.translate(q)
    assert "gen:" not in done.rewritten and "http://q/name" in done.rewritten
    assert engine.translate("SELECT * WHERE { ?s ?p ?o }").rewritten == "SELECT * WHERE { ?s ?p ?o }"
    top = engine.candidates(spark.createDataFrame([("gen:partOf",)], "generic string"), 0.2)
    assert {r["rank"] for r in top.collect()} == {1, 2}
    batch = engine.translate_batch(spark.createDataFrame([("a", q), ("b", "SELECT * WHERE { ?s ?p ?o }")], "query_id string, text string")).collect()
    assert {r["query_id"]: "SERVICE" in r["rewritten"] for r in batch} == {"a": True, "b": False}
    bad = {r["query_id"]: r for r in engine.translate_batch(spark.createDataFrame([("a", q), ("b", "SELECT { gen:label")], "query_id string, text string")).collect()}
    assert "SERVICE" in bad["a"]["rewritten"] and bad["b"]["rewritten"] is None and "Syntax" in bad["b"]["error"]
    vectors = spark.createDataFrame([(e, p, v) for (e, p), v in {("one", "http://p/partOf"): [1.0, 0.0], ("one", "http://p/label"): [0.0, 1.0], ("two", "http://q/isPartOf"): [1.0, 0.0], ("two", "http://q/name"): [0.0, 1.0]}.items()], "endpoint string, row_id string, embedding array<double>")
    encoder = lambda names: names.selectExpr("generic", "array(0.0D, 1.0D) as query")
    near = Engine(spark, engine.index | {"vectors": vectors}, URLS, settings=Settings(w_sparse=0.0, w_dense=1.0), encoder=encoder)
    top = near.candidates(spark.createDataFrame([("gen:partOf",)], "generic string")).where("rank = 1").collect()
    assert {r["predicate"] for r in top} == {"http://p/label", "http://q/name"}
    assert "\"rewritten\"" in engine.translate(q).to_json()
    with pytest.raises(MissingCatalog):
        Engine(spark, engine.index, None).translate(q)


@pytest.mark.parametrize("popa", [0.0, 0.4, -0.4])
def test_candidates_by_brute_force(spark, popa):
    """The rows kept for each endpoint give what ranking all rows would give."""
    import random

    rng = random.Random(3)
    words = "part of name label same as type is has date place born".split()
    rows = [(e, f"http://{e}/{rng.choice(words)}{rng.choice(words).title()}{i}", "", rng.randrange(50)) for e in ("one", "two") for i in range(40)]
    idx = index.build_index(spark.createDataFrame(rows, "endpoint string, predicate string, local_name string, usage_count long"))
    names = spark.createDataFrame([(f"gen:{w}_{v}",) for w, v in (("part", "of"), ("nothing", "known"), ("type", "place"))], "generic string")
    get = lambda df: sorted((r["generic"], r["endpoint"], r["rank"], r["predicate"], round(r["score_fused"], 5)) for r in df.collect())
    zero = idx["meta"].select(F.explode(F.array(*[F.lit(r["generic"]) for r in names.collect()])).alias("generic"), "endpoint", "row_id", F.lit(0.0).alias("score_dense"))
    assert get(search.search(idx, names, popa=popa)) == get(search.search(idx, names, popa=popa, dense=zero))


def test_selection(spark):
    answer = '{"mappings": [{"generic": "gen:a", "endpoint": "x", "predicate": null, "reason": "", "confidence": 0.9}, {"generic": "gen:a", "endpoint": "y", "predicate": "p", "reason": "", "confidence": 0.9}, {"generic": "gen:a", "endpoint": "y", "predicate": "q", "reason": "", "confidence": 0.5}, {"generic": "gen:", "endpoint": "y", "predicate": "q", "reason": "", "confidence": 0.5}]}'
    rows = selection.valid(selection.parse_response(spark.createDataFrame([(answer,)], "response string")))
    nested = {(r["generic"], r["endpoint"]): r["predicate"] for r in selection.last_write(rows).collect()}
    assert nested == {("gen:a", "x"): None, ("gen:a", "y"): "q"}
    assert selection.best_per_generic(rows).first()["predicate"] is None
    assert selection.best_per_generic(rows, ignore_null=True).first()["predicate"] == "p"
    with pytest.raises(selection.SelectorError):
        selection.parse_response(spark.createDataFrame([("no",)], "response string"))
    assert selection.json_schema()["required"] == ["mappings"]


def test_evaluation(spark):
    uses = generic_uses(spark.createDataFrame([("1", "gen:a gen:b gen:c gen:a"), ("2", "gen:a")], "query_id string, text string")).drop("pos")
    gold = spark.createDataFrame([("gen:a", "<x>"), ("gen:b", "y")], "gen_predicate string, expected string")
    predicted = spark.createDataFrame([("1", "gen:a", "x"), ("2", "gen:a", "z")], "query_id string, gen_predicate string, predicted string")
    rows = evaluation.judged(uses, gold, predicted)
    s = evaluation.summary(rows).first()
    assert (s["predicates"], s["correct"], s["incorrect"], s["replaced"], s["precision"]) == (3, 1, 2, 2, 33.33)
    assert [tuple(r) for r in evaluation.error_histogram(rows).collect()] == [("gen:a", 1), ("gen:b", 1)]


def test_command_lines(spark, tmp_path):
    from quadrille.__main__ import main

    def go(*args):
        main([str(x) for x in args], spark)

    dump = tmp_path / "dump"
    dump.mkdir()
    (dump / "a.nt").write_text("<http://x/a> <http://p/partOf> <http://x/b> .\n" * 3 + "<http://x/a> <http://p/label> <http://x/c> .\n")
    go("count", dump, "--out", tmp_path / "docs/one", "--endpoint", "one")
    doc = next((tmp_path / "docs/one/predicates.json").glob("part-*")).read_text()
    (tmp_path / "built/one").mkdir(parents=True)
    (tmp_path / "built/one/predicates.json").write_text(doc)
    go("build-index", tmp_path / "built", "--out", tmp_path / "index")
    (tmp_path / "endpoints.yml").write_text("endpoints:\n  - id: one\n    url: http://one/sparql\n")
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries/B1.tex").write_text("SELECT * WHERE { ?s gen:partOf ?o . ?o gen:label ?l }")
    (tmp_path / "queries/B2.tex").write_text("SELECT { gen:label")
    engine = ["--index", tmp_path / "index", "--endpoints", tmp_path / "endpoints.yml"]
    go("translate", tmp_path / "queries", "--out", tmp_path / "out", *engine)
    got = {r["query_id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert "SERVICE <http://one/sparql>" in got["B1"]["rewritten"] and "<http://p/partOf>" in got["B1"]["rewritten"] and got["B2"]["error"]
    (tmp_path / "gold.json").write_text('{"_note": "", "gen:partOf": "<http://p/partOf>", "gen:label": "http://p/other"}')
    go("evaluate", tmp_path / "queries", "--out", tmp_path / "report", "--gold", tmp_path / "gold.json", "--delay", 0, *engine)
    rows = {r["query_id"]: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert (rows["B1"]["correct"], rows["B1"]["incorrect"]) == (1, 1) and rows["B1"]["seconds"] > 0 and rows["B2"]["error"]
    n3 = tmp_path / "n3"
    n3.mkdir()
    (n3 / "a.n3").write_text("@prefix e: <http://e/> .\ne:a e:p e:b .\ne:bad .\n")
    go("convert-n3", n3, "--out", tmp_path / "nt")
    go("convert-n3", n3, "--dry-run")
    assert spark.read.text(str(tmp_path / "nt")).count() == 1 and spark.read.json(str(tmp_path / "nt-failures")).count() == 1


def test_one_subject_is_joined_by_a_shuffle_and_equated_texts_are_dealt(spark):
    """A small compressed file may hold more rows than the driver can broadcast; few bytes
    may make many pairs."""
    from quadrille.plans.execute import DEALT
    from quadrille.registry import bgp_chain, range_join

    plan = range_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count(f", {DEALT}), REPARTITION_BY_NUM") == 2, plan
    assert "BroadcastHashJoin" in bgp_chain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()  # few values of many rows are not dealt by


def test_whole_numbers_have_the_key_of_any_term(spark):
    from quadrille.functions.terms import any_key, key, number_key

    words = ["0", "-0", "7", "-12", "007", "123456789012345", "1234567890123456", "+5", "5.0", "1e3", "7\n", "", "-", "1995-03-01", '"7"', "ex:7", None]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", key(F.col("t")).alias("a"), any_key(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    five = spark.range(1).select(number_key(F.lit("5")).alias("a"), any_key(F.lit('"5"^^<http://www.w3.org/2001/XMLSchema#integer>')).alias("b"))
    assert five.where("a = b").count() == 1
