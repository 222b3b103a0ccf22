"""A cleaning pipeline over ``documents``: drop toxic texts, exact copies and near copies, mix the sources, encode.

In every stage a null text counts as empty, an empty table gives an empty table, repeated rows are rows of their own
until the stage of exact copies, a null doc_id comes after all others, texts are read whole, and columns of ``documents``
pass through whatever they are called (all but the last stage return them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm import exact_dedup, mixing, near_copies, sentencepiece_codec, toxicity
from citeflow.llm.common import Scratch
from citeflow.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic language, empty ones too. The model is fitted on the labelled documents of ``sf_dir``."""
    model = toxicity.fit_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id. All empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: near
    fingerprints meet by covering masks, pairs beyond their radius by their rarest shingles, and all are compared."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, in shuffled shards. Null sources are one source."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each row of the mix."""
    return sentencepiece_codec.encode_report(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Fitted weights, fingerprints, sampled quotas and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
