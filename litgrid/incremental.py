"""Curation that is kept up to date: only new and changed sources are read, and only papers that they, a text, a hint or a gold row touch are curated and scored anew.

What a run makes lies in folders of its own (cells/run=..., curated/run=..., scores). A small table of marks says, for each source, paper and score, from what it was made and
which run holds it; it is a stored table with versions (stores.commit), so a run is seen whole or not at all, and of two runs at once the later one fails with a Conflict. Rows of
untouched papers are never copied, only pointed to; compact() brings many runs together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid import api
from litgrid.functions import text as tx
from litgrid.operators import align, gold
from litgrid.sources import sheets, stores

#: kind: source, paper or score; mark: of what it was made from; run: which holds it; paper: whose it is; size and changed of a source's file; error of one that can't be read.
MARKS = "kind string, name string, mark string, run string, paper string, size long, changed timestamp, error string"
CELLS = "path string, table_no int, row_idx int, col_idx int, value string"
SCORES = ("summary", "fields", "sets")
#: At most how many tasks list the files of a read.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it, paths of a read are looked up by as many tasks as run at once: else each path is a task of its own, which the driver starts one after the other."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), max(32, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def digest(*columns: Column) -> Column:
    """A mark of values; a null is not an empty text."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def paper_of(path: str) -> Column:
    return F.coalesce(tx.leading_pmid(path), F.lit("NR"))


def literal(path: str) -> str:
    """A file's path as a pattern that only it fits."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def listed(spark: SparkSession, sources: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """((path, name, size, changed) of the files of sources, (source, error) of sources that are not there or have no reader). name: the path as the readers of its kind spell it. No content is read."""
    failed, by_kind = [], {}
    for s in dict.fromkeys(sources):
        try:
            by_kind.setdefault(sheets.kind_of(s) == "workbook", []).append(s)
        except ValueError as e:
            failed.append((s, repr(e)))

    def files(paths, workbook):
        return spark.read.format("binaryFile").load(paths).select("path", F.col("path" if workbook else "_metadata.file_path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    parts = [spark.createDataFrame([], "path string, name string, size long, changed timestamp")]
    for workbook, paths in by_kind.items():
        try:
            parts.append(files(paths, workbook))
        except AnalysisException:
            for p in paths:
                try:
                    parts.append(files([p], workbook))
                except AnalysisException as e:
                    failed.append((p, e.getCondition() or repr(e)))
    return reduce(DataFrame.unionByName, parts).distinct(), failed


def hashed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mark) of files by their content."""
    if not paths:
        return spark.createDataFrame([], "path string, mark string")
    return spark.read.format("binaryFile").load([literal(p) for p in paths]).select("path", F.sha2("content", 256).alias("mark"))


def source_marks(spark: SparkSession, sources: list[str], old: DataFrame, verify: bool) -> tuple[DataFrame, list[tuple[str, str]]]:
    """((path, name, mark, size, changed, known) of sources, failed ones). A file of the size and time of its last run keeps its mark unread, unless verify; known: whether its content was seen."""
    found, failed = listed(spark, sources)
    had = old.where("kind = 'source'").select("name", F.col("mark").alias("old_mark"), F.col("size").alias("old_size"), F.col("changed").alias("old_changed"))
    joined = found.join(had, "name", "left")
    same = F.coalesce((F.col("size") == F.col("old_size")) & (F.col("changed") == F.col("old_changed")), F.lit(False)) & F.lit(not verify)
    # the paths to read, as in any read of files, are a list on the driver
    fresh = [r[0] for r in joined.where(~same).select("path").collect()]
    marks = joined.join(hashed(spark, fresh), "path", "left").withColumn("mark", F.when(same, F.col("old_mark")).otherwise(F.col("mark")))
    return marks.select("path", "name", "mark", "size", "changed", F.coalesce(F.col("mark") == F.col("old_mark"), F.lit(False)).alias("known")), failed


def paper_marks(papers: DataFrame, hints: DataFrame | None, rules_mark: str) -> DataFrame:
    """(name, mark) of papers by text, hints and the rules in use."""
    own = papers.select(F.col("paper_id").cast("string").alias("name"), "text")
    if hints is None:
        return own.select("name", digest(F.col("text"), F.lit(rules_mark)).alias("mark"))
    said = hints.select(F.col("pmid").alias("h"), digest(F.col("table_idx"), F.col("field"), F.col("value")).alias("m")).groupBy("h").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("m")), ","), 256).alias("hint_mark"))
    return own.join(said, own["name"] == said["h"], "left").select("name", digest(F.col("text"), F.lit(rules_mark), F.col("hint_mark")).alias("mark"))


def plain_id(c: Column) -> Column:
    """A paper's id as text, of whatever spelling as a number."""
    return F.coalesce(c.cast("string").try_cast("double").cast("bigint").cast("string"), c.cast("string"))


def gold_marks(reference: DataFrame) -> DataFrame:
    """(name, mark) of papers by their gold rows, in any order; sums, so a paper of very many rows is summed in parts."""
    row = F.xxhash64(F.to_json(F.struct("*")))
    by = plain_id(F.col("`Pubmed PMID`")).alias("name")
    return reference.groupBy(by).agg(F.concat_ws(":", F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).alias("mark")).where("name is not null")


def held(spark: SparkSession, folder: str, pointers: DataFrame, key: str) -> DataFrame:
    """Rows of a folder of runs that the pointers (name, run) name."""
    rows = spark.read.parquet(folder)
    return rows.join(pointers.select(F.col("name").alias(key), "run"), [key, "run"]).drop("run")


def update(spark: SparkSession, papers: DataFrame, sources: list[str], settings: api.Settings, reference: DataFrame | None = None, hints: DataFrame | None = None, rule_table: DataFrame | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """Brings curated records (and per-paper scores, with a gold reference) up to date with papers(paper_id, text) and sources (files or patterns, named by their papers' ids).

    The rows are those of a run from nothing: api.curate of all sources. Sources that are no more, or papers that lost their text, are curated anew without them, and papers with neither are
    gone. Scores are those of papers whose id is a number. Papers are unique by id; several rows of one id are a ValueError. verify: files are read even if size and time are as before. Returns curated, source_errors(source, error), extracted(name) and recurated(name)
    of this run, and with a reference summary, fields and sets. An update that another one overtook raises stores.Conflict and leaves no trace in the tables."""
    folder = settings.folder("increments")
    run = f"r{uuid.uuid4().hex}"
    version, old = stores.read_version(spark, f"{folder}/marks", MARKS)
    if papers.groupBy("paper_id").count().where("count > 1").limit(1).count():
        raise ValueError("papers must be unique by paper_id")
    ruled = "" if rule_table is None else str(sorted(map(str, rule_table.limit(100_000).collect())))
    with few_listing_tasks(spark):
        marks, failed = source_marks(spark, sources, old, verify)
    stage = lambda df, name: kept(df, f"{folder}/work/{run}/{name}")
    marks = stage(marks.withColumn("paper", paper_of("name")), "sources")
    was = old.where("kind = 'source'")
    changed = marks.where("not known")
    gone = was.join(marks, "name", "left_anti")
    texts = paper_marks(papers, hints, ruled)
    owners = marks.select(F.col("paper").alias("name")).distinct()
    now = texts.join(owners, "name", "full").select("name", F.coalesce("mark", F.lit(ruled)).alias("mark"))
    before = old.where("kind = 'paper'").select("name", F.col("mark").alias("old_mark"), F.col("run").alias("old_run"))
    touched = changed.select("paper").unionByName(gone.select("paper")).distinct().select(F.col("paper").alias("name"), F.lit(True).alias("touched"))
    state = now.join(before, "name", "left").join(touched, "name", "left").withColumn("anew", F.coalesce("touched", ~(F.col("mark") == F.col("old_mark")), F.lit(True)))
    state = stage(state, "papers")
    anew = state.where("anew").select("name")

    fresh = [r[0] for r in changed.select("path").collect()]
    with few_listing_tasks(spark):
        cells, errors = sheets.readable_tables(spark, [literal(p) for p in fresh])
    if fresh or not version:
        cells.write.parquet(f"{folder}/cells/run={run}")
    errors = stage(errors.groupBy("source").agg(F.first("error").alias("error")), "errors")
    kept_marks = was.join(marks.where("known"), "name", "left_semi").select("name", F.col("run").alias("old_run"), F.col("error").alias("old_error"))
    by_source = marks.join(kept_marks, "name", "left").join(errors.withColumnRenamed("source", "name"), "name", "left")
    by_source = by_source.select(F.lit("source").alias("kind"), "name", "mark", F.coalesce("old_run", F.lit(run)).alias("run"), "paper", "size", "changed", F.when(F.col("known"), F.col("old_error")).otherwise(F.col("error")).alias("error"))
    by_paper = state.select(F.lit("paper").alias("kind"), "name", "mark", F.when(F.col("anew"), F.lit(run)).otherwise(F.col("old_run")).alias("run"), F.col("name").alias("paper"))
    pointers = stage(by_source.unionByName(by_paper, allowMissingColumns=True), "pointers")

    if not version or not anew.isEmpty():
        recurate(spark, papers, pointers, anew, hints, rule_table, folder).write.parquet(f"{folder}/curated/run={run}")
    curated = held(spark, f"{folder}/curated", pointers.where("kind = 'paper'"), "paper_id")
    out = {"curated": curated, "extracted": changed.select("name"), "recurated": anew}

    if reference is not None:
        golds = gold_marks(reference)
        scored = old.where("kind = 'score'").select("name", F.col("mark").alias("old_mark"), F.col("run").alias("old_run"))
        way = F.lit(f"{settings.scope}/{settings.mode}/{','.join(settings.ignored)}")
        scores = state.select("name", "anew").join(golds, "name", "left").withColumn("mark", F.concat_ws("/", way, "mark")).join(scored, "name", "left")
        scores = stage(scores.withColumn("anew", F.col("anew") | F.coalesce(F.col("mark") != F.col("old_mark"), F.lit(True))), "scores")
        again = scores.where("anew").select(F.col("name").alias("paper"))
        fs, at = stores.file_system(spark, folder)
        if not again.isEmpty() or not fs.exists(at(f"{folder}/summary")):
            for name, df in rescore(curated, reference, again, settings).items():
                df.write.parquet(f"{folder}/{name}/run={run}")
        by_score = scores.select(F.lit("score").alias("kind"), "name", "mark", F.when(F.col("anew"), F.lit(run)).otherwise(F.col("old_run")).alias("run"), F.col("name").alias("paper"))
        pointers = pointers.unionByName(by_score, allowMissingColumns=True)
        out |= {name: held(spark, f"{folder}/{name}", by_score, "paper") for name in SCORES}
    stores.commit(pointers, f"{folder}/marks", version)
    lost = pointers.where("error is not null").select(F.col("name").alias("source"), "error")
    return out | {"source_errors": lost.unionByName(spark.createDataFrame(failed, "source string, error string"))}


def recurate(spark: SparkSession, papers: DataFrame, pointers: DataFrame, anew: DataFrame, hints: DataFrame | None, rule_table: DataFrame | None, folder: str) -> DataFrame:
    """The curated records of papers anew(name), from the cells that their sources have by the pointers."""
    needed = pointers.where("kind = 'source'").join(anew.withColumnRenamed("name", "paper"), "paper", "left_semi")
    raw = api.of_papers(held(spark, f"{folder}/cells", needed, "path"))
    about = papers.withColumn("paper_id", F.col("paper_id").cast("string")).join(anew.withColumnRenamed("name", "paper_id"), "paper_id", "left_semi")
    # in tables of their own, so no plan is that of the whole curation, and nothing stays in memory
    keep = lambda df: kept(df, f"{folder}/work/{uuid.uuid4().hex}")
    return api.curate(about, keep(raw), hints, rule_table, keep)


def rescore(curated: DataFrame, reference: DataFrame, again: DataFrame, settings: api.Settings) -> dict[str, DataFrame]:
    """align.evaluate_sources of the papers again(paper), of curated records against gold rows."""
    own = curated.join(again.withColumnRenamed("paper", "paper_id"), "paper_id", "left_semi")
    tag = lambda df: df.withColumn("paper", plain_id(F.col("pmid")))
    pred = align.scoped(tag(gold.canonical_predicted(own)), settings.scope)
    pred = pred if "source_file" in pred.columns else pred.withColumn("source_file", F.lit("input"))
    known = tag(gold.canonical_gold(reference)).join(again, "paper", "left_semi")
    return align.evaluate_sources(pred, known, settings.mode, settings.ignored)


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def current(spark: SparkSession, settings: api.Settings, version: int | None = None) -> DataFrame:
    """The curated records as of the latest update, or of an earlier version."""
    folder = settings.folder("increments")
    _, marks = stores.read_version(spark, f"{folder}/marks", MARKS, version)
    return held(spark, f"{folder}/curated", marks.where("kind = 'paper'"), "paper_id")


def compact(spark: SparkSession, settings: api.Settings) -> int:
    """Brings what the latest version points to together in one run, and removes all other runs and versions (none may be writing, and earlier versions can't be read after). Returns the number of runs removed."""
    folder = settings.folder("increments")
    version, marks = stores.read_version(spark, f"{folder}/marks", MARKS)
    if not version:
        return 0
    run = f"r{uuid.uuid4().hex}"
    kinds = {"cells": ("source", "path"), "curated": ("paper", "paper_id")} | {s: ("score", "paper") for s in SCORES}
    fs, at = stores.file_system(spark, folder)
    there = {name: of for name, of in kinds.items() if fs.exists(at(f"{folder}/{name}"))}
    for name, (kind, key) in there.items():
        held(spark, f"{folder}/{name}", marks.where(F.col("kind") == kind), key).write.parquet(f"{folder}/{name}/run={run}")
    stores.commit(marks.withColumn("run", F.lit(run)), f"{folder}/marks", version)
    stores.compact(spark, f"{folder}/marks", 1)
    gone = {f.getPath().getName() for name in there for f in fs.listStatus(at(f"{folder}/{name}")) if f.getPath().getName() != f"run={run}"}
    for name in there:
        for g in gone:
            fs.delete(at(f"{folder}/{name}/{g}"), True)
    fs.delete(at(f"{folder}/work"), True)
    return len(gone)
