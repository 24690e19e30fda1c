"""Turtle, N3 and N-Triples of any size, cut at their true statement ends.

Spark's reader splits a file at byte ranges and hands out whole lines; what state the
tokenizer is in where a split begins, nobody knows yet. Names, numbers, IRIs, short
literals and comments end with their line at the latest, so a line begins in one of three
states: plain, in a long literal of double quotes, or in one of single quotes.

1. ``chunks``: every split is scanned once, line after line, from all three states at a
   time. A chunk of lines keeps, for each state its split may begin in, the state it is
   reached in, the chunk before it that holds the last statement end, and its own first
   and last statement end. Chunks are stored; they are the only copy of the text.
2. ``entered``: the state maps of whole splits are composed in the order of a file's
   splits, a row of a few numbers a split. That gives the state each begins in.
3. ``pieces``: with it, a chunk falls into the end of a statement begun before, whole
   statements, and the begin of one that goes on. Only the outer parts are shuffled, to
   be joined to the statement they make.
4. ``scopes``: prefixes and base are taken from the pieces that hold any and carried along
   the file; a piece finds the last scope before its place in a list its split has.
5. Pieces are parsed apart, whatever task they are in.

A statement longer than ``LONGEST`` characters (a long literal that never ends) is a
failure and is not gathered. Blank nodes are named by file, so labels of two files are
two nodes. A file without line ends is one line, and so one record of one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import stored

#: Characters of a chunk, about, and of a statement that is read.
CHUNK, LONGEST = 1 << 18, 64 << 20

_LONG = (r'(?:[^"\\]|\\.|"(?!""))*+"{3}', r"(?:[^'\\]|\\.|'(?!''))*+'{3}")
_OPEN = r"""(?!"{3}|'{3})"""
#: What stands between statement ends: the tokens of the parser but for the full stop.
_RUN = re.compile(
    rf"""(?:\s+|\#[^\n]*|<[^<>\s]*>|"{{3}}{_LONG[0]}|'{{3}}{_LONG[1]}|{_OPEN}(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
    rf"""|@[A-Za-z][\w-]*|_:[\w.-]*\w|[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?"""
    rf"""|(?:[A-Za-z_][\w.-]*?(?=:))?:(?:[\w%-]|\.(?=[\w%-])|\\.)*|[A-Za-z]+|{_OPEN}[^.])*+"""
)
_CLOSE = (None, *map(re.compile, _LONG))
_GAP = r"(?:\s|\#[^\n]*)*+"
_DIRECTIVE = re.compile(rf"{_GAP}(@?)(prefix{_GAP}[^\s:<>]*:|base){_GAP}(<[^<>\s]*>)(?:{_GAP}\.)?", re.I)
PLAIN, STATES = 0, 3


def scan(text: str, state: int = PLAIN) -> tuple[int, int, int]:
    """The state after ``text``, and the places after its first and last statement end
    (-1 without any)."""
    at, first, last = 0, -1, -1
    if state:
        closed = _CLOSE[state].match(text)
        if not closed:
            return state, first, last
        at = closed.end()
    while True:
        at = _RUN.match(text, at).end()
        if at >= len(text):
            return PLAIN, first, last
        if text[at] != ".":
            return (1 if text[at] == '"' else 2), first, last
        at += 1
        first, last = (at if first < 0 else first), at


def cut(text: str) -> Iterator[str]:
    """Statements of a text that begins plain, and what is left."""
    at = 0
    while at < len(text):
        end = min(len(text), _RUN.match(text, at).end() + 1)
        if end < len(text) and text[end - 1] != ".":  # a long literal without end
            end = len(text)
        yield text[at:end]
        at = end


def directives(text: str) -> str:
    """The prefix and base directives of a text, in their order, in one form."""
    out = []
    for one in cut(text):
        at = 0
        while m := _DIRECTIVE.match(one, at):
            out.append(f"@{re.sub(_GAP, '', m[2]) if m[2][:4].lower() == 'base' else 'prefix ' + re.sub('(?i)^prefix' + _GAP, '', m[2])} {m[3]} .")
            at = m.end()
    return "\n".join(out)


_BY = "by array<struct<entry:int,open:int,to:int,first:int,last:int>>"


def chunks(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``path, block, seq, text, by``, from lines ``path, block, value`` as the reader
    gives them."""

    def run(batches):
        import pyarrow as pa

        split, seq, held, size, state, opened = None, 0, [], 0, [0, 1, 2], [-1] * STATES
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("entry", "open", "to", "first", "last")]))

        def row():
            nonlocal seq, size, state, opened
            text = "".join(held)
            met = {s: scan(text, s) for s in sorted(set(state)) if s == PLAIN or '"""' in text or "'''" in text}
            met |= {s: (s, -1, -1) for s in set(state) if s not in met}  # a long literal goes on
            by = [{"entry": s, "open": o, "to": met[s][0], "first": met[s][1], "last": met[s][2]} for s, o in zip(state, opened, strict=True)]
            opened = [seq if met[s][2] >= 0 else o for s, o in zip(state, opened, strict=True)]
            state = [met[s][0] for s in state]
            out = (*split, seq, text, by)
            seq, size = seq + 1, 0
            held.clear()
            return out

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string(), kind), strict=True)], ["path", "block", "seq", "text", "by"])

        for b in batches:
            rows = []
            for path, block, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (path, block) != split:
                    if held:
                        rows.append(row())
                    split, seq, state, opened = (path, block), 0, [0, 1, 2], [-1] * STATES
                held.extend((line, "\n"))
                size += len(line) + 1
                if size >= chunk:
                    rows.append(row())
            if rows:
                yield batch(rows)
        if held:
            yield batch([row()])

    return lines.select("path", "block", "value").mapInArrow(run, f"path string, block long, seq int, text string, {_BY}")


def _grouped(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` over the rows of each path in the order of splits."""

    def run(t):
        import pyarrow as pa

        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        return pa.Table.from_pylist(list(f(rows)), schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return df.groupBy("path").applyInArrow(run, schema)


def entered(chunked: DataFrame) -> DataFrame:
    """``path, block, state, open_block, open_seq``: the state each split begins in, and the
    chunk that holds the last statement end before it; -1 at the begin of a file."""

    def compose(rows):
        state, opened = PLAIN, (0, -1)
        for r in rows:
            yield {"path": r["path"], "block": r["block"], "state": state, "open_block": opened[0], "open_seq": opened[1]}
            m = r["by"][state]
            if m["last"] >= 0 or m["open"] >= 0:
                opened = r["block"], r["seq"] if m["last"] >= 0 else m["open"]
            state = m["to"]

    ends = chunked.groupBy("path", "block").agg(F.max_by("by", "seq").alias("by"), F.max("seq").alias("seq"))
    return _grouped(ends, compose, "path string, block long, state int, open_block long, open_seq int")


def pieces(chunked: DataFrame, begins: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``path, block, seq, part, text``: whole statements (part 0) and, one a row, those that
    go on beyond the chunk of that number (part 1). ``text`` is null for one too long."""
    own = F.element_at("by", F.col("state") + 1)
    rows = chunked.join(begins, ["path", "block"]).withColumn("m", own)
    rows = rows.withColumns({"_first": F.col("m.first"), "_last": F.col("m.last"), "_to_block": F.when(F.col("m.open") >= 0, F.col("block")).otherwise(F.col("open_block")), "_to_seq": F.when(F.col("m.open") >= 0, F.col("m.open")).otherwise(F.col("open_seq"))})
    inner = F.substring("text", F.col("_first") + 1, F.col("_last") - F.col("_first"))
    whole = rows.where("_last > _first").select("path", "block", "seq", F.lit(0).alias("part"), inner.alias("text"))
    head = F.struct(F.col("_to_block").alias("b"), F.col("_to_seq").alias("q"), F.when(F.col("_first") >= 0, F.substring("text", F.lit(1), F.col("_first"))).otherwise(F.col("text")).alias("t"))
    tail = F.struct(F.col("block").alias("b"), F.col("seq").alias("q"), F.substring("text", F.col("_last") + 1, F.lit(1 << 30)).alias("t"))
    outer = rows.select("path", F.col("block").alias("_b"), F.col("seq").alias("_s"), F.explode(F.when(F.col("_last") >= 0, F.array(head, tail)).otherwise(F.array(head))).alias("x"))
    outer = outer.select("path", F.col("x.b").alias("block"), F.col("x.q").alias("seq"), "_b", "_s", F.col("x.t").alias("t")).where("t <> ''")
    key = ["path", "block", "seq"]
    much = outer.groupBy(*key).agg(F.sum(F.char_length("t")).alias("n")).where(F.col("n") > longest)
    joined = outer.join(much, key, "left_anti").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_s", "t"))), lambda x: x["t"]), "").alias("text"))
    over = much.select(*key, F.lit(None).cast("string").alias("text"))
    return whole.unionByName(joined.where(F.col("text").rlike(r"\S")).unionByName(over).withColumn("part", F.lit(1)))


def scopes(pieced: DataFrame, begins: DataFrame) -> DataFrame:
    """``path, block, scopes``: what prefixes and base hold from which piece on, the first
    from the begin of the split. A scope is a JSON object, the base under ``@base``."""

    def found(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([directives(t) for t in b.column(4).to_pylist()], pa.string())], b.schema.names)

    def carry(rows):
        from .rdf import TurtleError, parse_turtle

        scope: dict = {}
        for r in rows:
            held = [{"seq": -2, "part": 0, "scope": json.dumps(scope)}]
            for h in sorted(r["heads"] or (), key=lambda h: (h["seq"], h["part"])):
                for line in h["text"].split("\n"):
                    try:
                        list(parse_turtle(line, scope))
                    except TurtleError:  # its statement is a failure where it stands
                        continue
                held.append({"seq": h["seq"], "part": h["part"], "scope": json.dumps(scope)})
            yield {"path": r["path"], "block": r["block"], "scopes": held}

    some = pieced.where(F.col("text").rlike("(?i)prefix|base")).mapInArrow(found, "path string, block long, seq int, part int, text string").where("text <> ''")
    heads = some.groupBy("path", "block").agg(F.collect_list(F.struct("seq", "part", "text")).alias("heads"))
    rows = begins.select("path", "block").join(heads, ["path", "block"], "left")
    return _grouped(rows, carry, "path string, block long, scopes array<struct<seq:int,part:int,scope:string>>")


def scope_at(scopes_: Column, seq: Column, part: Column) -> Column:
    """The last scope before a place."""
    before = F.filter(scopes_, lambda x: (x["seq"] < seq) | (x["seq"] == seq) & (x["part"] < part))
    return F.element_at(before, -1)["scope"]


def file_of(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def node_names(path: str) -> dict:
    """How the blank nodes of a file are named: by the file, which no two share."""
    own = hashlib.blake2b(path.encode(), digest_size=8).hexdigest()
    return {"blank": f"_:g{own}x", "label": f"_:f{own}x".__add__}


def parse_each(texts: list[str], scope: dict, names: dict) -> Iterator[tuple]:
    """Triples with None, or None with error and text, statement after statement."""
    from .rdf import parse_turtle

    for k, one in enumerate(texts):
        if not _blank(one):
            try:
                yield from [(t, None) for t in list(parse_turtle(ended(one), scope, **names | {"blank": f"{names['blank']}{k}x"}))]
            except Exception as e:
                yield None, (f"{type(e).__name__}: {e}"[:500], one.strip().removesuffix(".").rstrip())


def parsed(placed: DataFrame) -> DataFrame:
    """``file, s, p, o, error, chunk`` of pieces with their ``scope``: a triple a row, and a row
    for each statement that cannot be parsed."""

    def run(batches):
        import pandas as pd

        from .rdf import parse_turtle

        for b in batches:
            out = []
            for file, path, place, text, scope in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is None:
                    out.append((file, None, None, None, "a statement too long to be read", None))
                    continue
                names = node_names(path)
                names["blank"] += f"{place}x"
                try:
                    out += [(file, *t, None, None) for t in list(parse_turtle(ended(text), json.loads(scope), **names))]
                except Exception:  # then one statement after another
                    out += [(file, *t, None, None) if t else (file, None, None, None, *e) for t, e in parse_each(list(cut(text)), json.loads(scope), names)]
            yield from (pd.DataFrame(out[i : i + 50_000], columns=["file", "s", "p", "o", "error", "chunk"]) for i in range(0, len(out), 50_000))

    def in_pandas(batches):
        import pyarrow as pa

        for df in run(batches):
            yield pa.RecordBatch.from_pandas(df, schema=kind, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "file string, s string, p string, o string, error string, chunk string"
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return placed.select("file", "path", "place", "text", "scope").mapInArrow(in_pandas, schema)


_EMPTY = re.compile(_GAP)


def _blank(text: str) -> bool:
    return _EMPTY.fullmatch(text) is not None


def ended(text: str) -> str:
    """With a full stop, should the file end without. Lines end with a line end, so a stop
    at the very end is one."""
    if text.endswith("."):
        return text
    rest = list(cut(text))[-1] if text else ""
    if _blank(rest) or rest.endswith("."):
        return text
    m = _DIRECTIVE.match(rest)
    while m and not _blank(rest[m.end() :]):
        n = _DIRECTIVE.match(rest, m.end())
        if not n:
            return text + "\n."
        m = n
    return text if m else text + "\n."


def statements(lines: DataFrame, chunk: int = CHUNK, longest: int = LONGEST) -> DataFrame:
    """``parsed`` of lines ``path, block, value``."""
    chunked = stored(chunks(lines, chunk), "rdf-chunks")
    begins = stored(entered(chunked), "rdf-splits")
    pieced = pieces(chunked, begins, longest)
    held = stored(scopes(pieced, begins), "rdf-scopes")
    at = scope_at(F.col("scopes"), F.col("seq"), F.col("part"))
    place = F.concat_ws("x", "block", F.col("seq") + 1, "part")
    return parsed(pieced.join(held, ["path", "block"]).select(file_of("path").alias("file"), "path", place.alias("place"), "text", at.alias("scope")))
