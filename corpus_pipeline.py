"""From raw documents to packed token rows, in five stages of the training-data operators.

Each stage reads what the one before it wrote, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch
from tessera.llm.decontam import decontam_stage
from tessera.llm.mixing import mix_stage
from tessera.llm.ngramjoin import near_stage
from tessera.llm.packing import pack_stage
from tessera.llm.quality import quality_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontam_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID / binary output", pack_stage),
]

#: A classifier and a packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = tmp.table(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
