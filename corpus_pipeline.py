"""A training-corpus pipeline: five stages, each written as Parquet and read again before the next.

Defined cases: null and empty texts are never toxic, duplicate, contaminated or personal, and are packed; each row has a
verdict of its own in every stage, whether it has a doc_id, shares one with other rows or has none; of a group of near
duplicates the row with the smallest id of its own stays, else one of the others; an empty table gives an empty result;
extra columns stay up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import materialize, release, scratch_until_written, table
from quillon.llm.decontaminate import decontaminate_stage
from quillon.llm.near_dedup import near_dedup_stage
from quillon.llm.packing import packing_stage
from quillon.llm.pii import pii_stage
from quillon.llm.toxicity import toxicity_stage

#: Toxic documents go; one document of each near-duplicate group stays; documents that hold a benchmark item go;
#: personal data in the texts is replaced; what is left is packed into bins.
STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned models decide in two of the stages; tests compare the whole run with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_until_written() as keep:
            before, docs = docs, keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        release(before)
    return docs
