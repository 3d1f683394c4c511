"""Shared Spark helpers of the llm operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a shared folder; the cluster names it in spark.checkpoint.dir. Only where that is unset and one
    process does all the work (tests, local mode) a folder of this machine is used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="litgrid-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing that is done."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared checkpoint folder: like cut, but later readers take only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... by place, so that no name of theirs clashes with one of an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def at_place(docs: DataFrame, name: str) -> Column:
    """The column of by_place(docs) that has the name in docs."""
    return F.col(f"c{docs.columns.index(name)}")


def named_again(df: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of by_place(docs) in df with their own names, and more."""
    kept = df.select(*[F.col(f"c{i}") for i in range(len(docs.columns))], *more)
    return kept.toDF(*docs.columns, *kept.columns[len(docs.columns) :])


def crc_of_id(column: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string").cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
