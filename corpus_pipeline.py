"""A training corpus from the documents table, in five stages.

Each stage works on all rows that the stage before it kept, and its decisions
take effect: toxic documents go, exact copies go, one document of each group of
near copies stays, the mix drops and repeats rows, and the last stage encodes
what is left.  Decisions come back to the rows by a row number of Spark's own,
so rows with null or repeated ids are decided like all others; where one row of
a group stays, those with an id come first.  Columns other than those of
``documents`` are dropped by the first stage.

A stage deletes the tables that it has settled for its decisions before it returns;
its lazy result reads at most the numbered rows and one number for each row that
stays, which meet in a merge join at every size (a broadcast of small decisions
would only make small runs look unlike large ones).  No stage deletes what another one, or another run, has settled.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from kinfold.llm.queries import MIX_CAP, MIX_WEIGHTS
from kinfold.operators.scratch import drop, numbered, passing, rank
from kinfold.operators.spread import spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]



def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the lexicon, learned from the labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with passing(spark):
        lexicon = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.clean(docs, lexicon).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text of all that the digest index gets."""
    with passing(spark) as keep:
        rows = numbered(docs.select(*COLUMNS), by=keep)
        index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
        decided = exact_dedup.dedup(rows.select(rank("doc_id").alias("_key"), "text"), index, id="_key")
        kept = keep(decided.filter("kept").select(F.col("doc_id.row").alias("_row")), "kept")
        index.drop()
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return near_dedup.survivors(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights: each document as many times
    as the mix takes it (rows that share an id count and are decided one by one)."""
    with passing(spark) as keep:
        rows = numbered(docs.select(*COLUMNS), by=keep)
        mixed = mixing.mix(rows, MIX_WEIGHTS, MIX_CAP, keep=["_row"])
        taken = keep(mixed.filter("copies > 0").select("_row", "copies"), "taken")
    return rows.join(taken.hint("merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Scores, near copies and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again.  A run owns
    its tables: what a stage leaves goes when the next one is written, and only the
    table that the result reads is left."""
    docs, left = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), []
    for name, apply in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, left)
        left = keep.kept
    return STAGES[-1][1](spark, docs, sf_dir)
