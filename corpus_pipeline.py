"""A corpus pipeline from operators of the training-data subpackage.

Each stage takes what its predecessor kept, as Parquet, and all but the last return
the columns of documents: quality rules reject documents, one document of each
group of near-duplicates stays, personal data in texts is replaced, sources are
mixed to target weights (a document may come twice), and texts become token ids.

Nulls and edge cases: a null or blank text fails the base rules and goes; a null language
is compared with other documents without one; a null source is a source; a row without a doc_id
can't be named by a group and stays; rows that repeat one doc_id stay or go together, and the mix
takes them together; ties are decided as the operators say (the smallest doc_id stays); very long
texts are taken whole; an empty table gives an empty result of the same columns; further columns
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.llm import mixing, near_dup, pieces, pii, quality_rules
from epochlake.llm.common import shared_dir, sweep
from epochlake.llm.queries import tokenizer_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select("doc_id", "source", "text"), tokenizer_model())
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", "source", n, "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mix", source_mix),
    ("pieces", token_ids),
]
#: Connected components, boosted trees and merges can't be put in SQL; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of documents; the others are written to the shared folder and read again.

    What a stage has put there for itself is removed once its result is written; the stages' results stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}-{name}")
            docs = spark.read.parquet(f"{where}/{k}-{name}")
            sweep(spark)
    return docs
