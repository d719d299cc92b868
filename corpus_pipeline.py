"""The corpus pipeline: five stages of ``lectern.llm``, each written and read again.

Quality classifier, line dedup, near-dedup, mixing of sources, packing. Every stage works on all that
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import stages
from lectern.llm.common import read, spool

STAGES = [
    ("quality", stages.keep_good),
    ("line_dedup", stages.drop_repeated_lines),
    ("near_dedup", stages.keep_one_of_near),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_tokens),
]

#: the classifier, the alignment and the tokenizer are beyond SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
