"""From raw documents to encoded training text, stage by stage.

Every stage takes what the one before kept and returns whole rows; the last one
adds the token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_copies
from spotflow.llm.common import small_batches, stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with whole texts handed to Python some megabytes at a time."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def free_name(name: str, docs: DataFrame) -> str:
    """The name, made longer until no column of the documents has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; the model learns from those that name theirs.

    Where none names its language there is no model, and nothing to reject by: all stay.
    """
    model = language_id.train(docs, RANKS)
    if not model.languages:
        return docs
    pred, score = free_name("lang_pred", docs), free_name("score", docs)
    return language_id.identify(docs, model, pred, score).where(F.col(pred) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


@in_small_batches
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id; the index is new in each run."""
    return exact_dedup.DigestIndex(spark, f"digests_{uuid4().hex}").keep(docs, "documents")


@in_small_batches
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash within 3 bits, or 0.8 of the 5-word shingles shared."""
    return near_copies.keep_one(docs)


@in_small_batches
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and whether they decode to the text."""
    return byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select(
        *docs.columns, "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same_text"),
    )


STAGES = [
    ("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near),
    ("benchmark decontamination", benchmark), ("byte-level BPE", encode),
]

#: Segmentation models, fingerprints, latent vectors and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
