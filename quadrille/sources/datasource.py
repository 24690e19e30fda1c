"""RDF files as a Spark data source: ``spark.read.format("rdf")``.

    register(spark)
    spark.read.format("rdf").load(folder).where("p = '<http://e/p>'")

Rows are ``file, s, p, o``. Files of N-Triples are planned as ranges of ``splitBytes`` bytes
(128 MB); a range owns the lines that begin in it. Turtle and RDF/XML are streamed, a
file a task, in memory of a block or a top node; large Turtle is better read by
``read_statements``, which splits it. Equality and IN on ``p`` are pushed to the reader,
which passes over lines without such an IRI before it parses them. With the option
``rows`` = ``failures`` the rows are ``file, error, chunk``, what could not be read.

Files are opened where the task runs, by the file systems pyarrow knows (local, HDFS,
S3, GCS); a store that only Spark can read needs ``read_statements`` or ``read_rdf``."""

from __future__ import annotations

import codecs
import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

TRIPLES, FAILURES = "file string, s string, p string, o string", "file string, error string, chunk string"
SPLIT, BLOCK, ROWS = 128 << 20, 1 << 20, 20_000
SUFFIXES = ("nt", "ttl", "n3", "rdf", "xml", "owl")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.dataSource.register(RdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class RdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return FAILURES if self.options.get("rows") == "failures" else TRIPLES

    def reader(self, schema) -> RdfReader:
        return RdfReader(dict(self.options))


@dataclass
class Part(InputPartition):
    path: str
    kind: str
    start: int = 0
    end: int | None = None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class RdfReader(DataSourceReader):
    options: dict
    wanted: frozenset | None = None
    pushed: list = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("p",):
                values = {f.value}
            elif isinstance(f, In) and f.attribute == ("p",):
                values = set(f.value)
            else:
                yield f
                continue
            self.wanted = frozenset(values if self.wanted is None else self.wanted & values)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        root, size = self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT)))
        system, path = _open(root)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out, glob = [], self.options.get("pathglobfilter", self.options.get("pathGlobFilter", "*"))
        for f in sorted(files, key=lambda f: f.path):
            kind = f.base_name.removesuffix(".gz").rsplit(".", 1)[-1].lower()
            if f.type != fs.FileType.File or f.base_name[0] in "._" or not f.size or not fnmatch(f.base_name, glob):
                continue
            kind = self.options.get("kind", kind)
            if kind not in SUFFIXES:
                continue
            at = "file://" + f.path if isinstance(system, fs.LocalFileSystem) else root.split("://")[0] + "://" + f.path.lstrip("/")
            if kind == "nt" and not f.base_name.endswith(".gz"):
                out += [Part(at, kind, a, min(a + size, f.size)) for a in range(0, f.size, size)]
            else:
                out.append(Part(at, kind))
        return out

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa

        failures = self.options.get("rows") == "failures"
        names = [x.split()[0] for x in (FAILURES if failures else TRIPLES).split(", ")]
        rows, file = [], part.path.rsplit("/", 1)[-1]
        for t, error in self._triples(part):
            if (error is not None) is failures and (failures or self.wanted is None or t[1] in self.wanted):
                rows.append((file, *error) if failures else (file, *t))
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    def _triples(self, part: Part) -> Iterator:
        """Triples, or None and an error with its text."""
        from .rdf import rdfxml_nodes
        from .statements import node_names

        own = node_names(part.path)
        system, path = _open(part.path)
        with system.open_input_file(path) as opened:
            raw = io.BufferedReader(opened, BLOCK)
            stream = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw
            if part.kind == "nt":
                yield from self._lines(stream, part, own)
            elif part.kind in ("rdf", "xml", "owl"):
                try:
                    for t in rdfxml_nodes(stream, **own):
                        yield t, None
                except Exception as e:
                    yield None, (f"{type(e).__name__}: {e}"[:500], None)
            else:
                yield from _streamed(stream, own)

    def _lines(self, stream, part: Part, own: dict) -> Iterator:
        from .rdf import parse_turtle

        at = part.start
        if at:
            stream.seek(at - 1)
            at += len(stream.readline()) - 1  # the line that began before is another range's
        wanted = None if self.wanted is None else re.compile(b"|".join(re.escape(w.encode()) for w in sorted(self.wanted)) or b"(?!)")
        while part.end is None or at < part.end:
            line = stream.readline()
            if not line:
                return
            at += len(line)
            if not line.strip() or line.lstrip().startswith(b"#") or wanted and not wanted.search(line):
                continue
            text = line.decode("utf-8", "replace")
            try:
                for t in list(parse_turtle(text, **own)):
                    yield t, None
            except Exception as e:
                yield None, (f"{type(e).__name__}: {e}"[:500], text.rstrip("\r\n"))


def _streamed(stream, own: dict) -> Iterator:
    """Statements of Turtle, a block of the file at a time."""
    from .statements import cut, ended, parse_each, scan

    decode, held, scope, k = codecs.getincrementaldecoder("utf-8")("replace"), "", {}, 0
    while True:
        block = stream.read(BLOCK)
        held += decode.decode(block, not block)
        whole = held if not block else held[: held.rfind("\n") + 1]
        last = scan(whole)[2]
        text, held = (held, "") if not block else (held[: max(0, last)], held[max(0, last) :])
        if text.strip():
            k += 1
            yield from parse_each(list(cut(text)) if block else list(cut(ended(text))), scope, own | {"blank": f"{own['blank']}{k}x"})
        if not block:
            return
