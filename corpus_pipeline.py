"""A corpus pipeline of five stages; each is one of the operators, with its decisions applied to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import decontam, language_id, line_dedup, packing, simhash
from evidra.llm.common import scratch, table

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: Learned trees, fingerprints and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
