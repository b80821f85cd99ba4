"""Corpus preparation in stages: each works on all that the one before it kept.

Every stage but the last returns the columns of documents. Between stages the rows are written as
Parquet in the folder that all executors share and read again, so a lost executor costs a part
of one stage at most.

Nulls, empty and very long texts, repeated rows and columns of any name are borne by every stage: an empty or null text is
harmless, a copy of every other such text, has no personal data, has size 0 (so it goes along with its source's rate) and packs as
one piece, the end id. Repeated rows are copies of each other, so one stays. Columns that stages use inside do not clash with
those of docs, which come out as they came. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import mixing, packing, pii, simhash, toxicity
from broadsheet.llm.common import stash, table


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine scores 0.3 or more."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind in brackets; n_chars follows."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.emit_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.pack(stash(packing.token_pieces(docs), "pieces"))


STAGES = [("toxicity", harmless), ("near-duplicates", distinct), ("personal data", redacted), ("mixing", mixed), ("packing", packed)]

#: A factorization machine's verdicts are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
