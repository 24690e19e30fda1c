"""A model asked in batches; what was answered is kept."""

import json

import pytest
from quadrille.engine import Engine
from quadrille.operators import index, selection as sel
from quadrille.operators.queries import rewritten


def model(path):
    def answer(messages):
        asked = json.loads(messages[1]["content"])
        with open(path, "a") as f:
            f.write(asked["query"] + "\n")
        if "fail" in asked["query"]:
            raise TimeoutError("too late")
        if "bad" in asked["query"]:
            return '{"mappings": [{"generic": "gen:label"}]}'
        rows = [{"generic": g, "endpoint": e, "predicate": c[0]["predicate"], "reason": "r", "confidence": 0.9} for g in asked["generics"] for e, c in sorted(asked["candidates"][g].items())]
        return json.dumps({"mappings": rows})

    return answer


def test_schema():
    want = {"type": "object", "additionalProperties": False, "required": ["generic", "endpoint", "predicate", "reason", "confidence"]}
    row = sel.json_schema()["properties"]["mappings"]["items"]
    assert {k: row[k] for k in want} == want
    assert row["properties"]["predicate"] == {"type": ["string", "null"]} and row["properties"]["confidence"] == {"type": "number", "minimum": 0, "maximum": 1}


def test_batches_ask_once(spark, tmp_path):
    records = spark.createDataFrame([("one", "http://x/partOf", "partOf", 3), ("one", "http://x/label", "label", 2)], "endpoint string, predicate string, local_name string, usage_count long")
    said = tmp_path / "said"
    engine = Engine(spark, index.build_index(records), {"one": "http://one/sparql"}, selector=sel.Asked(model(str(said)), str(tmp_path / "log")))
    ask = lambda p, tail="": f"SELECT ?s WHERE {{ ?s gen:{p} ?o{tail} }}"
    queries = spark.createDataFrame([("a", ask("partOf")), ("b", ask("label", " . ?o <e:fail> 1")), ("c", ask("label", " . ?o <e:bad> 1")), ("d", ask("partOf")), ("e", "SELECT ?s WHERE { ?s <e:p> ?o }"), ("f", "SELECT gen:partOf {")], "query_id string, text string")
    got = {r["query_id"]: r for r in engine.translate_batch(queries).collect()}
    assert "SERVICE <http://one/sparql>" in got["a"]["rewritten"] and got["d"]["rewritten"] == got["a"]["rewritten"] and got["e"]["rewritten"]
    assert "too late" in got["b"]["error"] and got["b"]["rewritten"] is None and "schema" in got["c"]["error"] and got["f"]["error"]
    asked = said.read_text().splitlines()
    assert len(asked) == 4  # a and d are one question
    again = {r["query_id"]: r["rewritten"] for r in engine.translate_batch(queries).collect()}
    assert again["a"] == got["a"]["rewritten"]
    assert len(said.read_text().splitlines()) == 5  # only the one without an answer is asked again
    done = engine.translate(ask("partOf"))
    assert "http://x/partOf" in done.rewritten and list(done.seconds) == ["parse", "select", "rewrite"]
    with pytest.raises(sel.SelectorError):
        engine.translate(ask("label", " . ?o <e:bad> 1"))


def test_texts_of_one_small_file_go_to_every_core(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as string) query_id", "concat('SELECT ?s WHERE { ?s gen:a ', id, ' }') text").coalesce(1).write.parquet(str(tmp_path / "q"))
    out = rewritten(spark.read.parquet(str(tmp_path / "q")), {"gen:a": {"one": "ex:p"}}, {"one": "http://one/"})
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r["query_id"]: r for r in out.collect()}
    assert len(got) == 40 and all(r["n_generics"] == r["n_triples"] == 1 and f"?s <ex:p> {i} ." in r["rewritten"] for i, r in got.items())
