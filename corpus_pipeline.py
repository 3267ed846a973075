"""A training corpus from raw documents: toxic ones go, one of each group of near copies stays, secrets are
redacted, and what remains is packed into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import minhash, packing, secrets, toxicity
from tracewarden.llm.common import table
from tracewarden.llm.components import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by a model fitted on the labelled ones among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, and one row of it for each text of its own.

    Rows without an id are in no group; all of them stay, as do documents without words.
    """
    found = minhash.near_duplicates(docs).checkpoint()
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    several = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rows = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = rows.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(several, "doc_id", "left_anti").unionByName(once)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced and lengths counted anew."""
    network = secrets.train(docs)
    return secrets.redact_secrets(docs.select(*COLUMNS), network).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    import public_tokenizers

    return packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("secrets", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read as the next one's."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext.applicationId}-{id(docs)}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and connected components are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None
