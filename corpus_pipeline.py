"""Documents to packed training sequences: quality, near-duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run``
writes each result to the shared folder and reads it back, so a lost executor costs one stage at most.
All stages but the last return the columns of their input.  Rows with null ids or texts, repeated rows,
empty tables and further columns are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bagminhash, leaks, packing, quality, suffix_arrays
from wardline.llm.tables import table, written
from wardline.session import configure


def _ready(spark: SparkSession) -> None:
    """Rows are whole texts: smaller Arrow batches, so that a batch of every task fits beside the executor's heap."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return bagminhash.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return suffix_arrays.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", repeat_stage),
    ("benchmark leaks", benchmark_stage),
    ("packing", packing_stage),
]

#: Signatures, suffix arrays and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
