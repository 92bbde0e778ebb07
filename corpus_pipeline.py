"""Training-data pipeline over `documents`: STAGES in order, each over all that the stage before kept, written in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import decontam, jaccard, line_dedup, mixing, toxicity
from ledgerscope.llm.common import bound_batches, is_remainder, row_key, small_or_shuffled, settle, table
from ledgerscope.sources import scratch

#: No stage of this kind of work (networks, rolling hashes, banding, postings, draws) is SQL; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; learned from the labels that are not held out."""
    own = docs.columns
    scored = toxicity.toxicity(docs.select(F.struct(*own).alias("_row"), "doc_id", "text"), table(spark, sf_dir, "labels"), ~is_remainder("doc_id", 4, 2))
    return scored.filter("predicted = 0").select("_row.*")


def drop_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that an earlier document has; n_chars follows the text. A document of which nothing is left goes."""
    bound_batches(spark)
    out = line_dedup.line_dedup(docs).filter(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.8."""
    bound_batches(spark)
    return jaccard.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows."""
    keyed = docs.withColumn("_own", row_key())
    found = decontam.contamination(keyed, table(spark, sf_dir, "benchmark"), "_own")
    bad = small_or_shuffled(settle(found.filter("contaminated").select("_own").distinct()))
    return keyed.join(bad, "_own", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix, and in which shards."""
    bound_batches(spark)
    mixed = mixing.mix(docs)
    shards = F.concat_ws(",", F.transform("places", lambda p: p["shard"]))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", shards.alias("shards"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_chunks),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch.folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
