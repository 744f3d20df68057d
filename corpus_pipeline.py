"""A corpus from raw documents to token ids, in stages that each read what the one before wrote."""

from __future__ import annotations

from eventloom.llm import copies, mixing, pieces, pii, quality
from eventloom.llm.common import bound_batches, clear, made, settle, table, written


def ready(spark):
    """The session as the operators want it, without what the stage before has left."""
    bound_batches(spark)
    settle(spark)


def classify(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; it learns from the labels, less the held-out rows."""
    ready(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays; candidates come from SimHash anchors, then from min-hash bands."""
    ready(spark)
    return copies.one_of_each(docs)


def sanitise(spark, docs, sf_dir):
    """Personal data are named by their kind; terms that reveal them are generalised or removed."""
    ready(spark)
    return pii.sanitise(docs)


def mix(spark, docs, sf_dir):
    """Sources come in their target shares: a document stands as often as the mix takes it."""
    ready(spark)
    return mixing.mixed(docs)


def tokenise(spark, docs, sf_dir):
    """doc_id and the ids of every text."""
    ready(spark)
    return pieces.encode(docs, pieces.Pieces()).select("doc_id", "ids")


STAGES = [("quality", classify), ("near-duplicates", deduplicate), ("personal data", sanitise), ("mix", mix), ("tokens", tokenise)]
#: The stages train a model and run Python; SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents; each result is written to the shared folder and read again, and what its stage wrote besides is removed."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        clear(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
