"""The corpus pipeline: STAGES in order, each written as Parquet and reread as the next one's documents.

1. quality classifier: documents scored under the threshold go;
2. SimHash near-dedup: of each component one row stays, that with the smallest id (null last), then by hash of the
   text, then by the other columns; rows of one id go only with their own component;
3. benchmark decontamination: contaminated documents go, by the rule of the operator;
4. PII: the spans are replaced by their kinds;
5. mixing: sizes, targets and the words that the mix takes, one row a document.

Defined cases, of all stages: null ids and different texts under one id are rows of their own; null texts are empty (and
stay null); rows alike are judged alike, of which near-dedup keeps one; other columns pass whatever their names, up to the
last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, pii, quality, simhash_dedup
from tessera.llm.base import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.firsts(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]
#: The classifier and the fingerprints are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = written(docs, f"stage{k}")
    return docs
