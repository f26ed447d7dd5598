"""From raw documents to packed token ids: each stage writes what it keeps, and the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandseries.llm.common import discard, scratch, scratch_of_a_step, table
from bandseries.llm.decontaminate import decontamination_stage
from bandseries.llm.mixing import mixing_stage
from bandseries.llm.neardup import dedup_stage
from bandseries.llm.quality import quality_stage
from bandseries.llm.tokens import token_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

#: Robust estimates, near-duplicate classes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables, and the stage before, are deleted once it is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        with scratch_of_a_step() as made:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        discard(spark, made + last)
        docs, last = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
