"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import mixing, neardup, packing, quality, toxicity
from factorloom.llm.common import fold, one_label, table
from factorloom.plans.durable import scratch_path

# A document goes if its quality score is lower, or its toxicity score is this high.
GOOD = 0.3
TOXIC = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from four fifths of the labelled ones."""
    labels = one_label(table(spark, sf_dir, "labels"), "doc_id", "quality").where(fold(F.col("_key"), 5) != 0)
    rows = quality.described(docs, {"_doc": F.col("doc_id")})
    model = quality.train(quality.labelled(rows, labels, "_doc"))
    return docs.where(quality.score_text(model, F.col("text")) >= GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns from three quarters of the labelled ones."""
    labels = one_label(table(spark, sf_dir, "labels"), "doc_id", "toxic").where(fold(F.col("_key"), 4) != 2)
    net = toxicity.train(docs, labels, F.col("doc_id"))
    rows = toxicity.read(docs, {"_doc": F.col("doc_id")}, net)
    net = toxicity.calibrated(rows, labels, net, "_doc")
    return docs.where(toxicity.score_text(net, F.col("text"), spark) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands there once per copy."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: ``doc_id, piece, start, length, sequence_id, offset``."""
    pieces = packing.stored_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
    placed = pieces.select("piece_id", "doc_id", "piece", "start", "length").join(packing.pack(pieces), "piece_id")
    return placed.drop("piece_id")


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Learnt models and sketches have no SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
