"""The corpus pipeline: toxicity, language ID, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages follow each other through Parquet. All but the last return the columns of
documents. run() applies them to documents and returns the last one's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language_id, toxicity
from tracewell.llm.near_copies import drop_near_copies
from tracewell.llm.packing import pack
from tracewell.llm.queries import toxicity_model
from tracewell.llm.store import discard, give_back, written
from tracewell.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Labels are learned from, as the query of this operator does."""
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).where("predicted = 0").select(*docs.columns)


def unknown_language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too far from every language go."""
    return language_id.identify(docs, language_id.fit(docs)).where("not rejected").select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return drop_near_copies(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows seen earlier go; the kept words are joined by one space and counted anew."""
    kept = substring_dedup(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return kept.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


#: Rows of an Arrow batch, at most. Rows are whole texts, and a batch is held by the executor and its Python worker at once.
BATCH = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """The stage with small Arrow batches, begun on executors that have given freed heap back."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
            spark.conf.set(_ROWS, str(BATCH))  # read when the stage's rows are asked for, so it stays set; run() puts it back
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(toxic_out)),
    ("language_id", in_small_batches(unknown_language_out)),
    ("simhash_near_dedup", in_small_batches(near_copies_out)),
    ("substring_dedup", in_small_batches(repeats_out)),
    ("best_fit_packing", in_small_batches(packed)),
]

#: Learned models, fingerprints and tokenisers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], spark.conf.get(_ROWS)
    try:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
            discard(*held)
            held = [docs]
        found = STAGES[-1][1](spark, docs, sf_dir)  # the pieces are written by now
        discard(*held)
    finally:
        spark.conf.set(_ROWS, before)
    return found
