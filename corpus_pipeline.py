"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of documents, the last one the mixture's rates for the documents kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm import decontaminate, linededup, mixing, shingles, toxicity
from tacgrid.llm.base import every, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by documents stay in the first alone; n_chars follows. Texts that lose all lines stay, empty."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*every(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, a Jaccard similarity of 0.8 or more.

    SimHash finds most links, a prefix join the others; all are settled by the shingles.
    """
    return shingles.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of the documents for the target weights; documents of rate zero go."""
    labels = table(spark, sf_dir, "labels")
    return mixing.mix(docs, mixing.labelled_domains(docs, labels), mixing.TARGETS).where("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_domains),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and fingerprints aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None
