"""Repairs of malformed N3 lines, as a chain of built-in replacements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOST = "http://bio2rdf"


def repair_line(line: Column) -> Column:
    """Doubled brackets, stray ``;`` or ``,`` before ``>``, quotes around an IRI, bare and
    unclosed IRIs, blanks and apostrophes inside an IRI."""
    x = F.regexp_replace(F.regexp_replace(line, "<{2,}", "<"), ">{2,}", ">")
    x = F.regexp_replace(x, r"[;,]+\s*>", ">")
    x = F.regexp_replace(x, rf'"+(<{HOST})', "$1")
    x = F.regexp_replace(x, rf'(<{HOST}[^<>"]*>)"+', "$1")
    x = F.regexp_replace(x, rf"(?<![<\w])({HOST}[^\s<>]*?)(?=\s|[;,.]?\s*$)", "<$1>")
    x = F.regexp_replace(x, rf"(<{HOST}[^<>\s]*)(?=\s+[<\"]|\s*\.\s*$)", "$1>")
    # blanks and apostrophes are escaped piece by piece between angle brackets
    pieces = F.split(x, "(?=<)|(?<=>)")
    inside = lambda p: F.replace(F.replace(p, F.lit(" "), F.lit("%20")), F.lit("'"), F.lit("%27"))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<http") & p.endswith(">"), inside(p)).otherwise(p)), "")
