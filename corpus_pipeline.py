"""A corpus pipeline of five stages. Each stage is written as Parquet to the shared folder and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readtally.llm import decontaminate, jaccard, lines, mixing, quality
from readtally.llm.shared import stored

#: (name, function(spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality", quality.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: MinHash candidates and a trained model have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
