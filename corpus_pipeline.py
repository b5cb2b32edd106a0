"""Documents to token ids: what is poor, of no clear language, a near copy or a benchmark leak goes; the rest is encoded.

Each stage takes ``(spark, docs, folder)`` and works on all that the one before kept. Stages other than the last return
the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdikt.llm import decontaminate, langid, pieces, quality, simhash
from verdikt.operators.lineage import shared_root

#: Pieces of the last stage.
PIECES = "piece_bpe_32k.model"
#: The stages learn and link, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


#: Columns that a stage makes on its way. Documents may have columns of these names, in any case, and keep them.
MADE = ("score", "predicted", "lang_pred", "ambiguous", "_id", "_digest", "_leak")


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called as in ``MADE`` under names of their own, and what names them back and drops all others."""
    names = [f"_kept{k}_{c}" if c.lower() in MADE else c for k, c in enumerate(docs.columns)]
    back = [(name, c) for name, c in zip(names, docs.columns)]
    renamed = docs.withColumnsRenamed({c: name for name, c in back if name != c})
    return renamed, lambda out: out.select(*[F.col(f"`{name}`").alias(c) for name, c in back])


def good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of quality 1."""
    docs, named_back = aside(docs)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return named_back(quality.score(docs, model).where("predicted = 1"))


def of_a_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is predicted without ambiguity."""
    docs, named_back = aside(docs)
    found = langid.predict(docs, langid.fit(docs))
    return named_back(found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")))


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    docs, named_back = aside(docs)
    return named_back(simhash.one_of_each(docs))


def unleaked(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    docs, named_back = aside(docs)
    return named_back(decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    return pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(PIECES)).drop("text")


STAGES = [("quality", good), ("language", of_a_language), ("near_duplicates", distinct), ("decontamination", unleaked), ("pieces", encoded)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, root = spark.read.parquet(f"{folder}/documents.parquet"), f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, folder).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
