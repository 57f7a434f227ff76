"""From raw documents to a training mix: five stages, each written and read again.

toxicity (rejected documents go), line dedup, MinHash near-dedup on five-word shingles at
0.8 (the smallest doc_id of a group stays), benchmark decontamination, mixing sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm import decontaminate, line_dedup, minhash_forest, mixing, toxicity
from quillset.storage import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels whose ids aren't held out; texts scored 0.7 or more go."""
    judged = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"), threshold=0.7)
    return judged.where("predicted = 0").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left."""
    out = line_dedup.drop_repeated_lines(docs, min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = minhash_forest.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = judged.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents plus copy, rate and mix_key."""
    return mixing.mix_sources(docs, temperature=0.7, epochs=1.0)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_near), ("decontamination", drop_leaked), ("mixing", mix)]

#: Learned scores, shingle links and alignments have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
