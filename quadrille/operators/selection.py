"""Choosing one endpoint and predicate for each generic."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .search import nested

#: One mapping of an answer. A predicate may be null, which stands for none.
MAPPING = StructType(
    [
        StructField("generic", StringType(), False),
        StructField("endpoint", StringType(), False),
        StructField("predicate", StringType(), True),
        StructField("reason", StringType(), False),
        StructField("confidence", DoubleType(), False, {"minimum": 0, "maximum": 1}),
    ]
)
RESPONSE = StructType([StructField("mappings", ArrayType(MAPPING), False)])
#: The same with numbers as text: an answer that writes one otherwise can still be read.
_READ = "mappings array<struct<generic:string,endpoint:string,predicate:string,reason:string,confidence:string>>"


def json_schema(kind=RESPONSE) -> dict:
    """The JSON schema of a type, as strict response formats want it: every field required,
    none besides."""
    if isinstance(kind, StructType):
        fields = {}
        for f in kind.fields:
            one = json_schema(f.dataType) | f.metadata
            fields[f.name] = one | ({"type": [one["type"], "null"]} if f.nullable else {})
        return {"type": "object", "additionalProperties": False, "required": kind.names, "properties": fields}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": "number" if isinstance(kind, DoubleType) else "string"}


class SelectorError(RuntimeError):
    """A selector failed or answered outside its schema."""


class Selector(Protocol):
    def select(self, query: str, candidates: DataFrame) -> DataFrame:
        """Mapping rows ``generic, endpoint, predicate, reason, confidence, pos``."""


class BestScore:
    """The best-ranked candidate of each endpoint; confidence grows with its fused score."""

    def select(self, query: str, candidates: DataFrame) -> DataFrame:
        confidence = F.round(1 / (1 + F.exp(-F.col("score_fused"))), 6)
        pos = F.row_number().over(Window.partitionBy("generic").orderBy("endpoint"))
        return candidates.where("rank = 1").select("generic", "endpoint", "predicate", F.lit("best fused score").alias("reason"), confidence.alias("confidence"), pos.cast("long").alias("pos"))


class Recorded:
    """A recorded JSON answer."""

    def __init__(self, answer: str):
        self.answer = answer

    def select(self, query: str, candidates: DataFrame) -> DataFrame:
        spark = candidates.sparkSession
        return parse_response(spark.createDataFrame([(self.answer,)], "response string"))


@dataclass
class Asked:
    """A model that is asked once for every query: ``model`` takes messages and gives the text
    of an answer, in the tasks. Answers go to the table ``log`` under a hash of what was
    asked, so a rerun, or a query that is there twice, asks nothing again. An error is no
    answer: it is reported, and asked again next time."""

    model: Callable[[list[dict[str, str]]], str]
    log: str

    def select(self, query: str, candidates: DataFrame) -> DataFrame:
        one = candidates.sparkSession.createDataFrame([("", query)], "query_id string, text string")
        uses = candidates.select(F.lit("").alias("query_id"), F.col("generic").alias("gen_predicate")).distinct().withColumn("pos", F.lit(0))
        rows, failed = self.batch(one, uses, candidates)
        for r in failed.collect():  # of one query
            raise SelectorError(r["error"])
        return rows.drop("query_id")

    def batch(self, queries: DataFrame, uses: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mapping rows with their ``query_id``, and ``query_id, error`` of queries without an
        answer that follows the schema. ``queries`` is ``query_id, text``, ``uses`` is
        ``query_id, gen_predicate, pos``."""
        spark, model = queries.sparkSession, self.model
        asked = prompts(queries, uses, candidates)

        def ask(batches):
            import pyarrow as pa

            for b in batches:
                out = []
                for key, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    try:
                        out.append((key, str(model(json.loads(prompt))), None))
                    except Exception as e:  # a query without an answer costs itself only
                        out.append((key, None, f"{type(e).__name__}: {e}"[:500]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, ["key", "response", "error"])

        known = self._known(spark)
        left = asked.select("key", "prompt").dropDuplicates(["key"])
        left = left if known is None else left.join(known.where("error is null"), "key", "left_anti")
        left.mapInArrow(ask, "key string, response string, error string").withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(self.log)
        answers = self._known(spark).groupBy("key").agg(F.max("response").alias("response"), F.max("error").alias("error"))
        met = asked.select("query_id", "key").join(answers, "key", "left").withColumn("r", F.from_json("response", _READ))
        good = follows(F.col("r"))
        failed = met.where(F.col("response").isNull() | ~good).select("query_id", F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no answer"))).otherwise("the answer does not follow the schema").alias("error"))
        return _mappings(met.where(F.col("response").isNotNull() & good), "query_id"), failed

    def _known(self, spark) -> DataFrame | None:
        try:
            return spark.read.schema("key string, response string, error string, run string").parquet(self.log)
        except AnalysisException:
            return None


RULES = ["Choose at most one predicate per endpoint for each generic.", "Use only the candidates given.", "Keep the direction of the relation.", "Answer with JSON that follows the schema only."]


def prompts(queries: DataFrame, uses: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, key, prompt``: messages for a remote model, as JSON, of each query with
    placeholders: its text, its placeholders in order, the candidates of each, the schema."""
    by_pos = lambda a, b: a["pos"] - b["pos"]  # noqa: E731  maps have no order of their own
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("gen_predicate").alias("g"), F.col("candidates").alias("c"))), by_pos), lambda x: F.struct(x["g"].alias("generic"), x["c"].alias("candidates")))
    per = uses.join(nested(candidates).withColumnRenamed("generic", "gen_predicate"), "gen_predicate", "left").groupBy("query_id").agg(listed.alias("generics"))
    payload = F.to_json(F.struct(F.col("text").alias("query"), F.col("generics.generic").alias("generics"), F.map_from_entries(F.col("generics")).alias("candidates"), F.lit(json.dumps(RULES)).alias("rules"), F.lit(json.dumps(json_schema())).alias("schema")))
    system = "You map placeholder predicates of a graph query to predicates that endpoints use. " + " ".join(RULES)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.to_json(F.array(message("system", F.lit(system)), message("user", payload)))
    return queries.join(per, "query_id").select("query_id", prompt.alias("prompt")).select("query_id", F.sha2("prompt", 256).alias("key"), "prompt")


def follows(r: Column) -> Column:
    """Whether a read answer has all that must be there."""
    return F.coalesce(r["mappings"].isNotNull() & ~F.exists(r["mappings"], lambda m: m.isNull() | m["generic"].isNull() | m["endpoint"].isNull()), F.lit(False))


def _mappings(answers: DataFrame, *keys: str) -> DataFrame:
    rows = answers.select(*keys, F.posexplode("r.mappings").alias("pos", "m"))
    value = F.coalesce(F.col("m.confidence").try_cast("double"), F.lit(0.0))
    return rows.select(*keys, "m.generic", "m.endpoint", "m.predicate", "m.reason", value.alias("confidence"), F.col("pos").cast("long").alias("pos"))


def parse_response(responses: DataFrame) -> DataFrame:
    """Mapping rows of JSON answers in ``response``, in their order; an answer that is not
    such JSON is an error, a confidence that is no number counts as 0."""
    rows = responses.select(F.from_json("response", _READ).alias("r"))
    if rows.where(~follows(F.col("r"))).limit(1).count():
        raise SelectorError("the answer does not follow the schema")
    return _mappings(rows)


def valid(rows: DataFrame) -> DataFrame:
    """Confidence within 0 and 1, generic with a prefix and a local part."""
    at = F.instr("generic", ":")
    key = (at > 1) & (F.trim(F.expr("substr(generic, instr(generic, ':') + 1)")) != "")
    return rows.where(key & F.col("confidence").between(0, 1))


def last_write(rows: DataFrame, keys=("generic", "endpoint"), value=("predicate", "reason", "confidence"), pos: str = "pos") -> DataFrame:
    """Of repeated keys the last value, at the place of the first."""
    last = F.max_by(F.struct(*value), pos)
    return rows.groupBy(*keys).agg(last.alias("_v"), F.min(pos).alias(pos)).select(*keys, *[F.col("_v")[c].alias(c) for c in value], pos)


def best_per_generic(rows: DataFrame, ignore_null: bool = False, keys=("generic",), confidence: str = "confidence", pos: str = "pos") -> DataFrame:
    """The row of highest confidence of each key, of equals the first. A null predicate can
    win, and then stands for none, unless ``ignore_null``."""
    rows = rows.where("predicate is not null") if ignore_null else rows
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(F.coalesce(confidence, F.lit(0.0)), -F.col(pos)))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def with_url(selected: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Adds ``url``; an endpoint that is an address is its own. The catalog is small
    configuration, but its join strategy is left to Spark."""
    known = endpoints.select(F.col("id").alias("endpoint"), F.col("url").alias("_url"))
    own = F.when(F.col("endpoint").startswith("http"), F.col("endpoint"))
    return selected.join(known, "endpoint", "left").withColumn("url", F.coalesce("_url", own)).drop("_url")
