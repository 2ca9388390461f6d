"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the next stage's documents. All stages but the last return
the columns of ``documents`` and work on all rows that the one before kept.

Extra columns pass through the first four stages, whatever their names; rows of null id are judged by their
texts like all others; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrub.llm import mixing, near_dups, packing, quality, toxicity
from scrub.llm.common import materialize, small_batches
from scrub.llm.queries import MIX, word_tokenizer


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as not toxic. Texts are scored in place: no join brings the verdict back.

    Null and empty texts hold no toxic word and stay; rows of equal text are judged alike.
    """
    small_batches(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest. Null, empty and short texts go; rows of equal text are judged alike."""
    small_batches(spark)
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links of five-word shingle similarity 0.8 or more connect.

    Rows that repeat that id and its text all stay. A row of null id stays unless its group has an id.
    """
    small_batches(spark)
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, 90 % of their tokens as far as cells reach, raked to the target weights.

    Null sources and languages are a class of their own. Draws depend on the id alone: rows that repeat an id, null
    among them, are drawn alike within their cell.
    """
    own = "_mix" + "_" * max(map(len, docs.columns))  # begins no column's name
    return mixing.mix(docs, MIX, budget=0.9, repeat=False, prefix=own).filter(f"{own}copies > 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens. Repeated rows are packed each; null ids stay null."""
    small_batches(spark)
    return packing.pack_documents(docs, word_tokenizer(), 4096, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages learn, tokenize and hash in ways that SQL can't express; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
