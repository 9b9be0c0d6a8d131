"""The corpus pipeline: five stages, each one of the training-data operators over all that its
predecessor kept. Every stage but the last returns the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planloom.llm import contamination, forest, lattice, pii, quality
from planloom.llm.common import held_out, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score under 0.7. Learns from the labelled ones that are not held out.

    Null and empty texts, which have no words, score as the bias alone and stay or go together; equal
    texts share their fate, repeated rows stay as often as they come. Columns of any name pass as they are.
    """
    cfg = quality.Ftrl()
    weights, bias = quality.fit(docs, table(spark, sf_dir, "labels"), cfg, ~held_out())
    return quality.passing(docs, weights, bias, cfg)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least id (a null id is less
    than any other; of equal ids the text with the lesser hash).

    Texts without words, null ones too, are copies of nothing: each stays, but rows with equal id and
    text count as one. Columns of any name pass as they are.
    """
    return forest.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item.

    Null, empty and very short texts hold none and stay, repeated rows as often as they come; items
    of fewer than five words drop nothing. Columns of any name pass as they are.
    """
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and sets n_chars anew; no document goes.

    A null text stays null with a null length, an empty one empty; repeated rows are masked alike.
    Columns of any other name pass as they are.
    """
    return pii.mask_pii(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text as two distinct sampled segmentations; the ids decode to the text. All columns
    but text stay beside them.

    Null and empty texts have one sample, the empty one; rows with equal ids and texts draw the same.
    A column that is called like a result (ids, log_prob, ...) gives way to it.
    """
    keep = [c for c in docs.columns if c != "text"]
    return lattice.sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, keep=keep)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", private_data),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the classifier nor the sampler; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
