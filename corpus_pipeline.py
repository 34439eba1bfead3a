"""Corpus clean-up: each stage takes what its predecessor kept and returns the columns of documents.

All but the last, which returns packed pieces with their token ids. Every stage
takes whole texts and works on tables of any size; an empty table stays empty,
and repeated rows and extra columns pass through the stages that keep documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fareindex.llm import langid, packing, secret_scan, simhash, toxicity
from fareindex.llm.common import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text alone tells with probability 0.3 or more; null, empty and letterless texts go."""
    return langid.keep_identified(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; a null text is scored as the empty one. Without labels of both classes all stay."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of texts chained by 5-word SimHash fingerprints within 2 bits or a similarity of 0.8 or more; null and wordless texts are one class."""
    return simhash.keep_representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked in `text` and `n_chars` set anew; a null text stays null."""
    return secret_scan.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens of every document, with their ids; a null text is one END token."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The models, fingerprint classes and the packer are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
