"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet below the shared checkpoint folder and reads it back as
the next stage's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from guardspark.llm.common import Stage, documents
from guardspark.llm.queries import bpe_path, mixing_levels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_rules(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them share."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), out_col="_kept_text")
    return out.select("doc_id", F.col("_kept_text").alias("text"), "lang", "source",
                      F.char_length("_kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (its smallest id)."""
    docs = docs.select(*COLUMNS)
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


#: Share of the corpus's tokens that the mixture takes; one epoch, so that no
#: document comes back twice after the deduplication.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of the domain-language-source tree."""
    out = mixing.mix(docs.select(*COLUMNS), mixing_levels(), mixing.word_tokens(F.col("text")),
                     target_share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return out.select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all remaining documents in training sequences."""
    return packing.pack(docs.select("doc_id", "text"), bpe_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near),
          ("mixing sources to target weights", mixture), ("best-fit packing", packed)]

#: The packing stage needs the tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        before, docs = docs, stage.put(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(before, "_stage_path"):
            stage.drop(before)
    return docs
