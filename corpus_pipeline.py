"""The corpus pipeline: toxicity, line deduplication, near-duplicates, packing, each stage over what the one before kept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import line_dedup, packing, simhash, toxicity
from lexweave.llm.common import stored, table

#: Bytes of an Arrow batch: both Spark and its Python workers hold batches whole.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH bytes, or what is set if that is less. Stages are lazy, so it can't be set back after them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmg]?)i?b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't call toxic, learned from the labels outside the held-out third.

    Null and empty texts are not toxic; repeated rows share their verdict; without labels none is dropped; an empty table stays empty.
    """
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their source; n_chars follows.

    A document most of whose text its source repeats is a near copy, and is left whole for the next stage to find. Null texts stay
    null; null sources are one source; repeated rows are pages each. Columns of any other name pass through.
    """
    cut = line_dedup.drop_boilerplate(docs, whole_above=0.5).withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8; the smallest id stays.

    Null and empty texts are copies of each other; rows of one id go or stay together; rows with a null id all stay.
    """
    small_batches(spark)
    groups = stored(simhash.near_duplicates(docs), "near-copies")
    gone = groups.where("id <> component_id").select(F.col("id").alias("doc_id"))
    # a merge join at every size: the ids that go grow with the documents
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, in the order of the Hilbert curve; a null or empty text is its end id."""
    import public_tokenizers as P

    small_batches(spark)
    return packing.pack(docs, P.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
