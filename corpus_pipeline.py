"""A corpus pipeline: each stage applies one operator to what its predecessor kept."""

from __future__ import annotations

from quadrille.llm.common import deleted, documents, stored, temporary
from quadrille.llm.exact import drop_copies
from quadrille.llm.language import keep_identified
from quadrille.llm.mixing import mixed_documents
from quadrille.llm.neardup import drop_near_copies
from quadrille.llm.pieces_dropout import encode_documents


def language(spark, docs, sf_dir):
    """Rows whose language is not recognised go."""
    return keep_identified(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts one row stays."""
    return drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of each group of near copies one row stays."""
    return drop_near_copies(docs)


def mixing(spark, docs, sf_dir):
    """Each row as often as the mix takes it, its copies numbered."""
    return mixed_documents(docs, copy_col="copy")


def pieces(spark, docs, sf_dir):
    """Piece ids of every row of the mix, copies split each on its own, and whether they decode to its text."""
    return encode_documents(docs, copy_col="copy")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("pieces", pieces)]

#: Language models, minhashes and seeded merges are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What a stage stores on its way goes when its own rows are
    stored, and its predecessor's rows with it; the last stage reads the rows before it
    when its result is read, so those stay."""
    docs, part = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        before, part = part, []
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", paths=part)
        deleted(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
