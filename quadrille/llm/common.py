"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between Spark and its workers.
BATCH = str(8 << 20)
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quadrille"
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    return _OWN[app]


_BINS: list[list[str]] = []


def stored(df: DataFrame, tag: str, lasting: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost
    executor costs a re-read, not a recomputation. Within ``temporary`` it goes at the
    end; a ``lasting`` one stays until the scope around that ends; with ``paths`` its path
    is added there, and it stays until the caller has it ``deleted``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadrille/{tag}-{uuid.uuid4().hex}"
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(batch)
    spark.conf.set(batch, BATCH)  # while this is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, was)
    if paths is not None:
        paths.append(path)
    elif len(_BINS) > lasting:
        _BINS[-1 - lasting].append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession):
    """What is stored in this scope is deleted at its end."""
    _BINS.append([])
    try:
        yield
    finally:
        deleted(spark, _BINS.pop())


_KEPT: dict = {}


def kept(name, build):
    """What a worker keeps from task to task: one object at a time, so that the stages of
    a pipeline do not add up."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = build()
    return _KEPT[name]


def by_bytes(batches, most: int = 32 << 20):
    """Record batches cut so that none is much over ``most`` bytes or 256 rows: whole
    texts become Python objects a batch at a time."""
    for b in batches:
        rows = max(1, min(256, b.num_rows * most // max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: Column | str = "text") -> Column:
    """With the id, the key of a row: rows that share an id, or have none, are told
    apart by their text."""
    return F.xxhash64(whole(text))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while (name := "_" + name).lower() in taken:
        pass
    return name


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose id and ``key`` are not in ``gone`` (``doc_id`` and ``key``);
    null ids equal each other."""
    a, b = (free(docs, c) for c in ("gone", "gone_key"))
    gone = gone.select(F.col("doc_id").alias(a), F.col(key).alias(b))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(a)) & (F.col(key) == F.col(b)), "left_anti")


def held_out(doc_id: str = "doc_id") -> Column:
    """Remainder 2 of crc32(doc_id as text) mod 4: rows nothing may be learned from.
    A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def falls_below(key: Column, share: float | Column, salt: str) -> Column:
    """Whether the 63-bit keyed hash of ``key`` lies in the first ``share`` of its range:
    shares far below one in a million still choose rows."""
    point = F.xxhash64(key.cast("string"), F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1))
    return point < (F.least(F.lit(1.0), share if isinstance(share, Column) else F.lit(float(share))) * 2.0**63)


def hash_sample(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    """Rows whose keyed hash falls below ``share``: the same rows in every run,
    without a shuffle."""
    return df.where(falls_below(F.col(key), share, salt))
