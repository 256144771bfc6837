"""A corpus pipeline of the operators in opineflow.llm: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.llm.common import materialize, read, release
from opineflow.llm.dart_minhash import keep_one_per_class
from opineflow.llm.line_chunks import remove_line_chunks
from opineflow.llm.packing import power_of_two_pack
from opineflow.llm.queries import tokenizer_path
from opineflow.llm.secret_ledger import redact_secrets
from opineflow.llm.toxicity_fm import drop_toxic, fit_toxicity


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at one half or more go."""
    return drop_toxic(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks and passages go from the texts; all documents stay."""
    return _counted(remove_line_chunks(docs, passages=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; null texts are empty ones."""
    return keep_one_per_class(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay, null texts as null."""
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces; a null text is empty and has the one id that ends a document."""
    return power_of_two_pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]
#: The score of a trained model, MinHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table goes once the next is written, the last one stays, as the result reads it."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
