"""Column expressions over IRIs, labels and words. All but ``strip_accents`` are built-in
functions, evaluated in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]{2,}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_name(iri: Column | str) -> Column:
    """Last piece between ``/`` and ``#``, angle brackets removed; empty after a
    trailing separator."""
    return F.element_at(F.split(F.regexp_replace(_col(iri), "[<>]", ""), "[/#]"), -1)


def last_path_segment(iri: Column | str) -> Column:
    """What follows the last ``/``."""
    return F.substring_index(_col(iri), "/", -1)


def label_tokens(x: Column | str, split_hyphen: bool = True) -> Column:
    """A label from an IRI: separators and camel case become spaces, percent escapes are
    decoded, lower case. Queries keep hyphens (``split_hyphen=False``)."""
    seg = F.substring_index(F.substring_index(_col(x), "/", -1), "#", -1)
    seg = F.regexp_replace(seg, r"[_\-.+]+" if split_hyphen else r"[_\\.+]+", " ")
    seg = F.regexp_replace(seg, "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.coalesce(F.try_url_decode(seg), seg))


def document_text(endpoint: Column | str, predicate: Column | str, name: Column | str) -> Column:
    """Indexed text of a predicate: the non-empty ones of IRI, local name and labels."""
    parts = [_col(predicate), _col(name), label_tokens(predicate), label_tokens(name), label_tokens(last_path_segment(endpoint))]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def query_text(generic: Column | str) -> Column:
    return F.concat_ws(" ", _col(generic), label_tokens(generic, split_hyphen=False))


def words(text: Column | str) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, lambdas inside included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ngrams(tokens: Column, longest: int = 3) -> Column:
    """1- to ``longest``-grams, joined by a space."""

    def of(w: Column, n: int) -> Column:
        grams = w
        for k in range(1, n):  # past the end zip_with gives null
            grams = F.zip_with(grams, F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams

    return let(tokens, lambda w: F.concat(*[of(w, n) for n in range(1, longest + 1)]))


def strip_accents(text: Column | str) -> Column:
    """NFKD without combining marks; Spark has no built-in normalisation."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return strip(_col(text))


def bare_iri(x: Column | str) -> Column:
    """Without blanks and angle brackets around it; null is empty."""
    return F.coalesce(F.trim(F.btrim(F.trim(_col(x)), F.lit("<>"))), F.lit(""))


def bracketed_iri(x: Column | str) -> Column:
    """One pair of angle brackets, no blanks inside."""
    return F.concat(F.lit("<"), F.replace(F.btrim(_col(x), F.lit("<> ")), F.lit(" "), F.lit("")), F.lit(">"))


def popularity(count: Column | str) -> Column:
    return F.log1p(F.coalesce(_col(count), F.lit(0)))


def long_or_zero(x: Column | str) -> Column:
    return F.coalesce(_col(x).try_cast("bigint"), F.lit(0).cast("bigint"))


def double_or_zero(x: Column | str) -> Column:
    return F.coalesce(_col(x).try_cast("double"), F.lit(0.0))


def first_of(*names: Column | str) -> Column:
    """First alias that is present and not empty."""
    return F.coalesce(*[F.nullif(_col(n), F.lit("")) for n in names])


def zscore(x: Column, window) -> Column:
    """Population z-score; NaN counts as missing."""
    seen = F.nanvl(x, F.lit(None).cast("double"))
    return (x - F.avg(seen).over(window)) / (F.stddev_pop(seen).over(window) + 1e-9)
