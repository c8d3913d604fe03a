"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir). The first four return rows of documents with its columns;
the last returns packed rows of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import decontamination, language_id, mixing, near_dedup, packing
from pagestrata.session import shared_folder

STAGES = [
    ("language_id", language_id.keep_identified),
    ("near_dedup", near_dedup.keep_first),
    ("decontamination", decontamination.keep_clean),
    ("mixing", mixing.take_mix),
    ("token_packing", packing.packed),
]

#: SQL can't express the stages' methods; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Between stages the rows go to Parquet in the folder that the cluster shares."""
    from uuid import uuid4

    place = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}-{name}")
            docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
