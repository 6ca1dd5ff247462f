"""From raw documents to token ids in five stages. Each stage's rows are written as Parquet and read as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, exact_dedup, sentencepiece, simhash, toxicity
from larkspur.llm.common import Scratch, table
from larkspur.llm.queries import TOKENIZERS


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain, fitted on the labelled ones of ``docs``, finds toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in their five-word shingles one stays, that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts stretches of ten or more words of a benchmark item out of texts; drops texts that are half such words."""
    cut = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the piece numbers of the text, how many, and whether they decode to the text."""
    encoded = sentencepiece.encode(docs, sentencepiece.read_model(f"{TOKENIZERS}/piece_bpe_32k.model"), check="decodes")
    return encoded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("benchmark decontamination", cut_benchmark),
    ("sentencepiece", to_pieces),
]

#: SQL has no SimHash, no chain of classifiers and no pieces: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(f"stage{k}", stage(spark, docs, sf_dir))
    return docs
