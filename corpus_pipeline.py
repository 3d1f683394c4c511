"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The driver writes each stage's
result and reads it again as the next one's docs; run() does the same in the shared checkpoint folder's stead by cutting the lineage.

Cases, as the operators define them: quality rules reject null, wordless and short texts; of repeated rows one is left by the Jaccard join, of copies and near copies the one of the
smallest id (null ids last); null texts hold no passage of the benchmark; the mix takes a document as often as it crosses, at most twice; null texts are one group of the
shards. Empty tables give no rows at any stage, very long texts are read whole, and columns of any name are kept; the last stage adds shard (shard_no if there is one).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from litgrid.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from litgrid.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Without a table of labels, bands are those of scripts."""
    try:
        labels = read(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return quality_rules.keep(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Fertility and near-duplicate components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
