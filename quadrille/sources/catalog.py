"""Predicate documents, endpoint catalogs, query corpora, gold mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import first_of, last_path_segment, long_or_zero

#: A superset of the accepted shapes; what is absent reads as null.
_PREDICATE = "struct<iri:string,usage_count:string,local_name:string>"
_DOCUMENT = f"version string, id string, endpoints array<struct<id:string,url:string,predicates:array<{_PREDICATE}>>>, predicates array<{_PREDICATE}>"
_STRINGS = "id string, endpoints array<struct<id:string,predicates:array<string>>>, predicates array<string>"


class UnknownShape(ValueError):
    """A predicate document with neither endpoints nor predicates."""


def predicate_records(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """``endpoint, predicate, local_name, usage_count`` of predicate documents: a list of
    endpoints (the named one, else the first), one endpoint, or bare predicates. A
    predicate is an object or a string; empty IRIs go, bad counts are 0."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _DOCUMENT).alias("d"), F.from_json("value", _STRINGS).alias("t"))

    def chosen(doc: str):
        named = F.filter(f"{doc}.endpoints", lambda e: e["id"] == F.lit(endpoint))
        return F.coalesce(F.get(named, F.lit(0)), F.get(f"{doc}.endpoints", F.lit(0)))

    raw = raw.withColumns({"e": chosen("d"), "te": chosen("t")})
    if raw.where("e is null and te is null and d.predicates is null and t.predicates is null").limit(1).count():
        raise UnknownShape(path)
    name = F.coalesce(F.lit(endpoint), F.col("e.id"), F.col("te.id"), F.col("d.id"), F.col("t.id"), F.lit(""))
    strings = F.coalesce("te.predicates", "t.predicates")
    # a list of strings does not parse as objects: then the strings stand alone
    objects = F.coalesce("e.predicates", "d.predicates", F.transform(strings, lambda s: F.lit(None).cast(_PREDICATE)))
    strings = F.transform(strings, lambda s: F.when(~s.startswith("{"), s))
    both = F.transform(F.arrays_zip(objects.alias("o"), strings.alias("s")), lambda x: F.struct(F.coalesce(x["o"]["iri"], x["s"]).alias("iri"), x["o"]["usage_count"].alias("n"), x["o"]["local_name"].alias("l")))
    rows = raw.select(name.alias("endpoint"), F.explode(both).alias("p"))
    return records(rows.select("endpoint", F.col("p.iri").alias("iri"), F.col("p.n").alias("usage_count"), F.col("p.l").alias("local_name")))


def records(df: DataFrame) -> DataFrame:
    """Index records from ``endpoint, iri, usage_count, local_name``."""
    iri = F.trim("iri")
    return df.where(iri != "").select("endpoint", iri.alias("predicate"), first_of("local_name", last_path_segment(iri)).alias("local_name"), long_or_zero("usage_count").alias("usage_count"))


def discover_endpoints(spark: SparkSession, root: str) -> list[str]:
    """Names of the sub-folders that hold a ``predicates.json``, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "predicates.json").load(root)
    names = files.select(F.regexp_extract("path", r"/([^/]+)/predicates\.json$", 1).alias("n")).distinct().orderBy("n")
    return [r["n"] for r in names.collect()]  # one row an endpoint


def parse_endpoints(entries) -> list[tuple[str, str]]:
    """``(id, url)`` of a catalog: a list of entries or a mapping, under any of the known
    key names; an id that is itself an address is its own URL."""
    items = [({"id": k} | (v if isinstance(v, dict) else {"url": v})) for k, v in entries.items()] if isinstance(entries, dict) else entries
    out = []
    for e in items:
        name = next((e[k] for k in ("id", "name", "endpoint", "alias") if e.get(k)), None)
        url = next((e[k] for k in ("service", "sparql", "url", "endpoint", "iri") if isinstance(e.get(k), str) and e[k]), None)
        url = url or (name if isinstance(name, str) and name.startswith("http") else None)
        if isinstance(name, str) and url:
            out.append((name, url))
    return out


def read_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """``id, url`` of a YAML catalog; a catalog is configuration and small."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    data = yaml.safe_load(text)
    return spark.createDataFrame(parse_endpoints(data.get("endpoints", data) if isinstance(data, dict) else data), "id string, url string")


def read_queries(spark: SparkSession, path: str, glob: str = "*.tex") -> DataFrame:
    """``query_id, text``, a row per file."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]+$", 1).alias("query_id"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``gen_predicate, expected``; keys that begin with ``_`` or ``$`` are notes."""
    gold = F.from_json("value", "map<string,string>")
    gold = F.map_filter(gold, lambda k, v: ~(k.startswith("_") | k.startswith("$")))
    return spark.read.text(path, wholetext=True).select(F.explode(gold).alias("gen_predicate", "expected"))


def not_built(endpoints: DataFrame, built: DataFrame) -> DataFrame:
    """Endpoints without an index yet."""
    return endpoints.join(built.select("endpoint").distinct(), "endpoint", "left_anti")
