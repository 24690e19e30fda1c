"""RDF dumps as DataFrames: ``endpoint, file, s, p, o``.

``read_ntriples`` takes lines as they are. ``read_statements`` reads Turtle, N3 and N-Triples
of any size in parts (see ``statements``); what cannot be parsed goes to a table of
failures, statement by statement. ``read_rdf`` parses a file in one task, RDF/XML too."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .statements import CHUNK, node_names, statements

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
MODES = ("nt_fields", "second_iri", "graph")
#: Formats by suffix; what else there is counts as Turtle.
FORMATS = {"nt": "nt", "n3": "n3", "ttl": "turtle", "rdf": "xml", "xml": "xml", "owl": "xml"}


class NoInput(FileNotFoundError):
    """The folder holds no dump."""


def _lines(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path)
    if not df.inputFiles():
        raise NoInput(f"{path} has no {glob}")
    return df.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))


def fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^[ \t]+|[ \t]+$", ""), r"[ \t]+")


def read_ntriples(spark: SparkSession, path: str, endpoint: str | None = None, glob: str = "*.{nt,nt.gz}", spread: int | None = None) -> DataFrame:
    """Lines of three or more fields whose second begins with ``<``, comments apart.
    Compressed files are one task each to read; ``spread`` deals their lines out again."""
    lines = _lines(spark, path, glob)
    lines = lines.repartition(spread) if spread else lines
    x = lines.select("path", "file", fields(F.col("value")).alias("f"), "value")
    x = x.where((F.size("f") >= 3) & ~F.col("f")[0].startswith("#") & F.col("f")[1].startswith("<"))
    obj = F.regexp_replace(F.regexp_replace("value", r"^[ \t]*[^ \t]+[ \t]+[^ \t]+[ \t]+", ""), r"[ \t]*\.[ \t]*$", "")
    own = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:f"), F.hex(F.xxhash64("path")), F.lit("x"), F.substr(c, F.lit(3)))).otherwise(c)  # noqa: E731  a node of its file
    return x.select(F.lit(endpoint).alias("endpoint"), "file", own(F.col("f")[0]).alias("s"), F.col("f")[1].alias("p"), own(obj).alias("o"))


def predicates(spark: SparkSession, path: str, mode: str = "nt_fields", endpoint: str | None = None, glob: str = "*.{nt,nt.gz}") -> DataFrame:
    """``endpoint, file, p``, a row per use, by one of three ways to count: the second
    field of a line; the second ``<...>`` of a line; distinct triples of a file."""
    if mode == "nt_fields":
        return read_ntriples(spark, path, endpoint, glob).select("endpoint", "file", "p")
    if mode == "second_iri":
        lines = _lines(spark, path, glob).where(~F.trim("value").startswith("#"))
        p = F.get(F.regexp_extract_all("value", F.lit("<([^>]+)>"), F.lit(1)), F.lit(1))
        return lines.select(F.lit(endpoint).alias("endpoint"), "file", F.concat(F.lit("<"), p, F.lit(">")).alias("p")).where("p is not null")
    if mode == "graph":
        good, _ = read_rdf(spark, path, endpoint)
        return good.dropDuplicates(["file", "s", "p", "o"]).select("endpoint", "file", "p")
    raise ValueError(f"mode is one of {MODES}")


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<lit>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<at>@[A-Za-z][\w-]*)|(?P<dt>\^\^)|(?P<bnode>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_][\w.-]*?(?=:)|(?=:)):(?P<rest>(?:[\w%-]|\.(?=[\w%-])|\\.)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])"""
)


#: What N-Triples write with a backslash and other notations may have bare.
_BARE, _ESCAPED = re.compile(r'(\\.)|["\n\r]', re.S), {'"': '\\"', "\n": "\\n", "\r": "\\r"}


class TurtleError(ValueError):
    pass


def parse_turtle(text: str, scope: dict[str, str] | None = None, blank: str = "_:genid", label=lambda name: f"_:{name}") -> Iterator[tuple[str, str, str]]:
    """Statements of Turtle, N3 data and N-Triples: prefixes, lists of predicates and
    objects, blank node property lists and collections. ``scope`` holds prefixes, and the
    base under ``@base``, and takes up what the text defines. ``blank`` begins the names of
    nodes without a label; ``label`` names those that have one."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at:at + 20]!r}")
        if m.lastgroup or m["rest"] is not None:
            tokens.append(m)
        at = m.end()
    prefix, out, fresh, i = {} if scope is None else scope, [], 0, 0

    def kind(k: int = 0) -> str:
        if i + k >= len(tokens):
            return ""
        m = tokens[i + k]
        return m["mark"] or ("name" if m["rest"] is not None else m.lastgroup)

    def node() -> str:
        nonlocal fresh
        fresh += 1
        return f"{blank}{fresh}"

    def term() -> str:
        nonlocal i
        k, m = kind(), tokens[i] if i < len(tokens) else None
        i += 1
        if k == "iri":
            iri = m["iri"][1:-1]
            return f"<{iri if re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', iri) else prefix.get('@base', '') + iri}>"
        if k == "name":
            if (m["name"] or "") not in prefix:
                raise TurtleError(f"unknown prefix {m['name']}")
            return f"<{prefix[m['name'] or '']}{m['rest']}>"
        if k == "bnode":
            return label(m["bnode"][2:])
        if k == "num":
            n = m["num"]
            return f'"{n}"^^<{XSD}{"double" if "e" in n.lower() else "decimal" if "." in n else "integer"}>'
        if k == "word" and m["word"] in ("true", "false"):
            return f'"{m["word"]}"^^<{XSD}boolean>'
        if k == "lit":
            q = 3 if m["lit"][:3] in ('"""', "'''") else 1
            body = '"' + _BARE.sub(lambda x: x[1] or _ESCAPED[x[0]], m["lit"][q:-q]) + '"'
            if kind() == "at":
                i += 1
                return body + tokens[i - 1]["at"]
            if kind() == "dt":
                i += 1
                return f"{body}^^{term()}"
            return body
        if k == "[":
            one = node()
            if kind() != "]":
                pairs(one)
            expect("]")
            return one
        if k == "(":
            items = []
            while kind() != ")":
                items.append(term())
            expect(")")
            nodes = [node() for _ in items] + [f"<{RDF}nil>"]
            for a, b, x in zip(nodes, nodes[1:], items):
                out.extend([(a, f"<{RDF}first>", x), (a, f"<{RDF}rest>", b)])
            return nodes[0]
        raise TurtleError(f"unexpected {k or 'end'}")

    def expect(mark: str) -> None:
        nonlocal i
        if kind() != mark:
            raise TurtleError(f"expected {mark}")
        i += 1

    def pairs(subject: str) -> None:
        nonlocal i
        while True:
            if kind() == "word" and tokens[i]["word"] == "a":
                i, p = i + 1, f"<{RDF}type>"
            else:
                p = term()
            out.append((subject, p, term()))
            while kind() == ",":
                i += 1
                out.append((subject, p, term()))
            while kind() == ";":
                i += 1
                if kind() in (".", "]", ""):
                    return
            if tokens[i - 1]["mark"] != ";":
                return

    while i < len(tokens):
        word = (tokens[i]["at"] or tokens[i]["word"] or "").lower().lstrip("@")
        if word in ("prefix", "base"):
            dotted, i = tokens[i]["at"] is not None, i + 1
            if word == "prefix":
                if kind() != "name":
                    raise TurtleError("expected a prefix")
                name, i = tokens[i]["name"] or "", i + 1
                prefix[name] = term()[1:-1]
            else:
                prefix["@base"] = term()[1:-1]
            if dotted:
                expect(".")
            continue
        pairs(term()) if kind(1) != "." or kind() != "[" else term()
        expect(".")
        yield from out
        out.clear()


_WRITTEN = str.maketrans(_ESCAPED | {"\\": "\\\\"})
_XML = "{http://www.w3.org/XML/1998/namespace}"
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "") if tag.startswith("{") else tag


class _Nodes:
    """Triples of node elements: typed nodes, property attributes, resources, literals,
    collections, ``xml:base`` and ``xml:lang`` of any element around."""

    def __init__(self, blank: str, label):
        self.blank, self.label, self.count, self.out = blank, label, 0, []

    def fresh(self) -> str:
        self.count += 1
        return f"{self.blank}{self.count}"

    def resolved(self, iri: str, base: str) -> str:
        return f"<{iri if _ABSOLUTE.match(iri) else base.partition('#')[0] + iri if iri[:1] == '#' or not iri else urljoin(base, iri)}>"

    def literal(self, text: str, lang: str | None, kind: str | None = None) -> str:
        body = '"' + text.translate(_WRITTEN) + '"'
        return body + (f"^^<{kind}>" if kind else f"@{lang}" if lang else "")

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        rdf = lambda name: e.get(f"{{{RDF}}}{name}")
        if rdf("about") is not None:
            s = self.resolved(rdf("about"), base)
        elif rdf("ID") is not None:
            s = self.resolved("#" + rdf("ID"), base)
        else:
            s = self.label(rdf("nodeID")) if rdf("nodeID") else self.fresh()
        if _iri(e.tag) != RDF + "Description":
            self.out.append((s, f"<{RDF}type>", f"<{_iri(e.tag)}>"))
        self.attributes(s, e, base, lang)
        item = 0
        for child in e:
            if _iri(child.tag) == RDF + "li":
                item += 1
                self.property(s, f"{RDF}_{item}", child, base, lang)
            else:
                self.property(s, _iri(child.tag), child, base, lang)
        return s

    def attributes(self, s: str, e: ET.Element, base: str, lang: str | None) -> bool:
        found = False
        for k, v in e.attrib.items():
            if k == f"{{{RDF}}}type":
                self.out.append((s, f"<{RDF}type>", self.resolved(v, base)))
            elif k.startswith("{") and not k.startswith((f"{{{RDF}}}", _XML)):
                self.out.append((s, f"<{_iri(k)}>", self.literal(v, lang)))
            else:
                continue
            found = True
        return found

    def property(self, s: str, p: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang, inner = e.get(_XML + "base", base), e.get(_XML + "lang", lang), list(e)
        rdf = lambda name: e.get(f"{{{RDF}}}{name}")
        place = len(self.out)
        if rdf("resource") is not None:
            o = self.resolved(rdf("resource"), base)
            self.attributes(o, e, base, lang)
        elif rdf("nodeID"):
            o = self.label(rdf("nodeID"))
        elif rdf("parseType") == "Literal":
            o = self.literal((e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in inner), None, RDF + "XMLLiteral")
        elif rdf("parseType") == "Resource":
            o = self.fresh()
            for x in inner:
                self.property(o, _iri(x.tag), x, base, lang)
        elif rdf("parseType") == "Collection":
            items = [self.node(x, base, lang) for x in inner]
            nodes = [self.fresh() for _ in items] + [f"<{RDF}nil>"]
            for a, b, x in zip(nodes, nodes[1:], items):
                self.out += [(a, f"<{RDF}first>", x), (a, f"<{RDF}rest>", b)]
            o = nodes[0]
        elif inner:
            o = [self.node(x, base, lang) for x in inner][0]
        elif rdf("datatype") is None and any(k.startswith("{") and not k.startswith((f"{{{RDF}}}", _XML)) for k in e.attrib):
            o = self.fresh()
            self.attributes(o, e, base, lang)
        else:
            o = self.literal(e.text or "", lang, rdf("datatype"))
        self.out.insert(place, (s, f"<{p}>", o))


def rdfxml_nodes(stream, blank: str = "_:x", label=lambda name: f"_:{name}") -> Iterator[tuple[str, str, str]]:
    """Triples of RDF/XML, read from a stream: a node element below the root is dropped once
    its triples are out, so memory is that of the largest one."""
    nodes, depth, root = _Nodes(blank, label), 0, None
    for event, e in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            root, depth = root if depth else e, depth + 1
            continue
        depth -= 1
        whole = _iri(root.tag) == RDF + "RDF"
        if depth == (1 if whole else 0) and (e is not root or not whole):
            around = root if whole else {}
            nodes.node(e, around.get(_XML + "base") or "", around.get(_XML + "lang"))
            yield from nodes.out
            nodes.out.clear()
            if whole:
                root.remove(e)


def parse_rdfxml(text: str | bytes, **names) -> Iterator[tuple[str, str, str]]:
    return rdfxml_nodes(io.BytesIO(text.encode() if isinstance(text, str) else text), **names)


def read_rdf(spark: SparkSession, path: str, endpoint: str | None = None, glob: str = "*.{nt,nt.gz,rdf,xml,n3,ttl}") -> tuple[DataFrame, DataFrame]:
    """Triples of all files, and ``file, error`` of those that cannot be parsed. Format by
    suffix; a gzip file is opened in the task."""
    return parse_texts(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), endpoint)


def parse_texts(files: DataFrame, endpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same, of ``path, content``."""

    def parse(batches):
        import gzip

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                file = name.rsplit("/", 1)[-1]
                try:
                    data = gzip.decompress(content) if file.endswith(".gz") else content
                    suffix = file.removesuffix(".gz").rsplit(".", 1)[-1].lower()
                    rows = list(parse_rdfxml(data, **node_names(name)) if FORMATS.get(suffix) == "xml" else parse_turtle(data.decode("utf-8", "replace"), **node_names(name)))
                except Exception as e:  # whatever is wrong with one file, the others are read
                    yield pd.DataFrame([(file, None, None, None, f"{type(e).__name__}: {e}"[:500])], columns=["file", "s", "p", "o", "error"])
                    continue
                for i in range(0, len(rows), 50_000):
                    part = pd.DataFrame(rows[i : i + 50_000], columns=["s", "p", "o"])
                    yield part.assign(file=file, error=None)[["file", "s", "p", "o", "error"]]

    got = files.select("path", "content").mapInPandas(parse, "file string, s string, p string, o string, error string")
    good = got.where("error is null").select(F.lit(endpoint).alias("endpoint"), "file", "s", "p", "o")
    return good, got.where("error is not null").select("file", "error")


def read_statements(spark: SparkSession, path: str, endpoint: str | None = None, glob: str = "*.{n3,ttl,nt}", recursive: bool = True, repair: bool = False, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Triples of Turtle, N3 or N-Triples, and ``file, error, chunk`` of the statements
    that cannot be parsed. Files are read in parts and give what a parse of the whole
    gives, statement by statement; ``chunk`` is how many characters are scanned together.
    ``repair`` mends each line first."""
    from ..functions.repair import repair_line

    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
    if not lines.inputFiles():
        raise NoInput(f"{path} has no {glob}")
    value = F.make_valid_utf8("value")
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), (repair_line(value) if repair else value).alias("value"))
    got = statements(lines, chunk)
    good = got.where("error is null").select(F.lit(endpoint).alias("endpoint"), "file", "s", "p", "o")
    return good, got.where("error is not null").select("file", "error", "chunk")


def convert_n3(spark: SparkSession, path: str, out: str, recursive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Repairs, parses and writes N3 files as N-Triples to ``out``; the failures, which
    ``read_statements`` tells apart, are returned."""
    from .sinks import write_ntriples

    good, bad = read_statements(spark, path, None, "*.n3", recursive, True, chunk)
    write_ntriples(good, out)
    return bad


def read_n3_lines(spark: SparkSession, path: str, recursive: bool = True, dry_run: bool = False) -> DataFrame:
    """Repaired lines of N3 files; a dry run reads the first 1000."""
    from ..functions.repair import repair_line

    lines = _lines(spark, path, "*.n3", recursive)
    return (lines.limit(1000) if dry_run else lines).select("file", repair_line(F.col("value")).alias("value"))
