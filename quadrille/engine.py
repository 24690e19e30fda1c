"""The engine: placeholder queries in, federated queries or their results out."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import search as search_ops
from .operators.selection import Asked, BestScore, Selector, best_per_generic, last_write, valid
from .plans.execute import execute
from .plans.rewrite import rewrite_tree
from .plans.sparql import GENERIC_TOKEN, Query, generics, parse, show

log = logging.getLogger("quadrille")


class MissingCatalog(LookupError):
    """No endpoint catalog was given."""


@dataclass
class Settings:
    top_k: int = search_ops.TOP_K
    w_sparse: float = search_ops.SPARSE
    w_dense: float = search_ops.DENSE
    popularity: float = search_ops.POPULARITY
    ignore_null: bool = False
    compat_grouping: bool = False
    repair_idf: bool = True  # terms that lost their idf count with 1


@dataclass
class Translation:
    mapping: dict
    rewritten: str
    tree: Query | None = None
    params: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)  # by stage

    def to_json(self) -> str:
        return json.dumps({"mapping": self.mapping, "rewritten": self.rewritten, "params": self.params}, ensure_ascii=False)


class Engine:
    def __init__(self, spark: SparkSession, index: dict[str, DataFrame], endpoints: dict[str, str] | None, selector: Selector | None = None, settings: Settings | None = None, encoder: Callable[[DataFrame], DataFrame] | None = None):
        """``encoder``: from ``generic`` to ``generic, query`` (a vector), for an index with
        ``vectors``."""
        self.encoder = encoder
        self.spark, self.index, self.endpoints = spark, index, endpoints
        self.selector, self.settings = selector or BestScore(), settings or Settings()

    def health(self) -> dict[str, str]:
        return {"status": "ok", "spark": self.spark.version}

    def candidates(self, names: DataFrame, popularity: float | None = None) -> DataFrame:
        s = self.settings
        dense = None
        if self.encoder is not None and "vectors" in self.index:
            dense = search_ops.dense_all(self.index["vectors"], self.encoder(names))
        elif (self.encoder is None) != ("vectors" not in self.index):
            log.warning("dense search needs both vectors and an encoder: left out")
        return search_ops.search(self.index, names, s.top_k, s.w_sparse, s.w_dense, s.popularity if popularity is None else popularity, dense, repair=s.repair_idf)

    def selected(self, text: str, names: DataFrame, popularity: float | None = None) -> DataFrame:
        """One row per generic: ``generic, endpoint, predicate, reason, confidence``."""
        rows = valid(self.selector.select(text, self.candidates(names, popularity)))
        return best_per_generic(last_write(rows), self.settings.ignore_null)

    def translate(self, text: str, popularity: float | None = None) -> Translation:
        began, request = time.time(), uuid.uuid4().hex[:8]
        names = generics(text)
        log.info("%s: %d placeholders", request, len(names))
        if not names:
            return Translation({"candidates": {}, "selected": {}}, text)
        if self.endpoints is None:
            raise MissingCatalog("endpoint catalog")
        seconds, at = {}, time.time()
        query = parse(text)
        seconds["parse"], at = time.time() - at, time.time()
        rows = self.selected(text, self.spark.createDataFrame([(n,) for n in names], "generic string"), popularity).collect()  # a row per placeholder
        seconds["select"], at = time.time() - at, time.time()
        chosen = {r["generic"]: (r["endpoint"], r["predicate"]) for r in rows if r["predicate"]}
        tree = rewrite_tree(query, chosen, self.endpoints, self.settings.compat_grouping)
        rewritten = show(tree)
        seconds["rewrite"] = time.time() - at
        mapping = {r["generic"]: {r["endpoint"]: {"predicate": r["predicate"], "reason": r["reason"], "confidence": r["confidence"]}} for r in rows}
        log.info("%s: %d of %d placeholders chosen in %.2f s (%s)", request, len(chosen), len(names), time.time() - began, ", ".join(f"{k} {v:.2f}" for k, v in seconds.items()))
        return Translation({"selected": mapping}, rewritten, tree, {"top_k": self.settings.top_k, "popularity": self.settings.popularity if popularity is None else popularity}, seconds)

    def translate_batch(self, queries: DataFrame) -> DataFrame:
        """``query_id, text, rewritten, error`` for ``query_id, text``: one search for all. A
        query that cannot be read has an error and no rewritten text."""
        uses = generic_uses(queries)
        failed = None
        if isinstance(self.selector, Asked):  # each query with its own text
            names = self.candidates(uses.select(F.col("gen_predicate").alias("generic")).distinct())
            rows, failed = self.selector.batch(queries.select("query_id", "text"), uses, names)
            rows = best_per_generic(last_write(valid(rows), ("query_id", "generic", "endpoint")), self.settings.ignore_null, ("query_id", "generic"))
            met = rows.where("predicate is not null")
        else:
            chosen = self.selected("", uses.select(F.col("gen_predicate").alias("generic")).distinct()).where("predicate is not null")
            met = uses.join(chosen, F.col("gen_predicate") == F.col("generic"))
        per = met.groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("generic", F.struct("endpoint", "predicate")))).alias("chosen"))
        urls, compat = dict(self.endpoints or {}), self.settings.compat_grouping

        @F.pandas_udf("rewritten string, error string")
        def apply(text: pd.Series, chosen: pd.Series) -> pd.DataFrame:
            out = []
            for t, c in zip(text, chosen, strict=True):
                try:
                    out.append((show(rewrite_tree(parse(t), {k: (v["endpoint"], v["predicate"]) for k, v in json.loads(c or "{}").items()}, urls, compat)), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(out, columns=["rewritten", "error"])

        done = queries.join(per, "query_id", "left").select("query_id", "text", apply("text", F.to_json("chosen")).alias("_r"))
        done = done.select("query_id", "text", "_r.rewritten", "_r.error")
        if failed is None:
            return done
        done = done.join(failed.withColumnRenamed("error", "_why"), "query_id", "left")
        return done.select("query_id", "text", F.when(F.col("_why").isNull(), F.col("rewritten")).alias("rewritten"), F.coalesce("_why", "error").alias("error"))

    def run(self, text: str, quads: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
        """Translate a query and run it over ``endpoint, s, p, o``."""
        done = self.translate(text)
        return execute(done.tree or parse(text), quads, prefixes, self.endpoints)


def generic_uses(queries: DataFrame) -> DataFrame:
    """``query_id, gen_predicate, pos``: first use of each placeholder in each query."""
    found = queries.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(GENERIC_TOKEN), F.lit(0))).alias("pos", "gen_predicate"))
    return found.groupBy("query_id", "gen_predicate").agg(F.min("pos").alias("pos"))
