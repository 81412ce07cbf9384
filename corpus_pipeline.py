"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``; a driver writes its result as Parquet
and hands what it reads back to the next one.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from quillon.llm import exact_dedup, mixing, near_dedup, packing, quality, scratch


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go.

    The labels of ``sf_dir`` fit it.  Every row is judged by its whole text alone: null and
    empty texts as the empty text, repeated rows and rows without an id each.  An empty
    table stays empty; other columns may have any names.
    """
    scratch.prepare(spark)
    return quality.keep_good(docs, scratch.table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of documents with equal normalised texts one stays: the longest, then the smallest id.

    Null, empty and blank texts are equal; a null id loses to any other; of rows that
    repeat one stays.  Very long texts are compared whole.  An empty table stays empty;
    other columns may have any names.
    """
    scratch.prepare(spark)
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group of near duplicates (word 5-shingles, similarity 0.8 or more) the smallest id stays.

    Rows without words or without an id are in no group and stay; rows that share an id
    are one group and stay together.  Very long texts are compared whole.  An empty table
    stays empty; other columns may have any names.
    """
    scratch.prepare(spark)
    return near_dedup.keep_one(docs, percent=80)


def mixing_stage(spark, docs, sf_dir):
    """Each source gets its tempered share of the token budget: its documents in whole epochs and a part.

    A null source is a source; sources without tokens go; rows without an id, with a
    repeated one and repeated rows are chosen one by one.  A text longer than what is left
    of its source's budget is not in the partial epoch.  An empty table stays empty;
    other columns may have any names.
    """
    scratch.prepare(spark)
    return mixing.mix_documents(docs)


def packing_stage(spark, docs, sf_dir):
    """The documents' pieces with their places in sequences of 4096 tokens.

    Null and empty texts are the end id alone; longer ones than a sequence are cut; rows
    that repeat and rows without an id are packed each.  An empty table gives no pieces;
    other columns are ignored.
    """
    scratch.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, the tokens and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole of ``documents``."""
    docs = scratch.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stash(docs, "stage")
    return docs
