"""Stores of runs: logs, trackers, annotations and reports, as folders of JSON, CSV or Parquet that any worker can write and read."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgrid.functions.links import base_name, sheet_pmid, sheet_table_number

#: Fields of a run log, of a tracker entry, and columns of the ranked publication list.
RUN = "pmid string, pmcid string, owner_name string, paper_input string, table_links array<string>, generated_tables array<string>, generated_harmonized array<string>, eval_report string, created_at string"
TRACKER = "pmid string, pmcid string, owner_name string, paper_input string, table_links array<string>, status string, priority string, message string, run_log string, eval_report string, edit_path string, table_count bigint, paper_title string, updated_at string"
STATUSES = ("new", "in_progress", "complete")
PUBLICATIONS = ["pmid", "year", "title", "publication_types", "mesh_terms", "score", "is_alzheimers_relevant", "reason"]


def inside(path: str, root: str) -> str:
    """path, made absolute under root; a ValueError if it leads out of it."""
    scheme = urlparse(path).scheme
    if scheme and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    if scheme:
        tail = path[len(root.rstrip("/")) + 1 :]
        if ".." in tail.split("/"):
            raise ValueError(f"{path} is outside {root}")
        return path
    full = os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
    if not urlparse(root).scheme and full != os.path.normpath(root) and not full.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return full


def existing(spark: SparkSession, read, schema: str) -> DataFrame:
    """read(), or no rows of the schema where nothing has been stored yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_run(runs: DataFrame, folder: str) -> None:
    """Adds run logs, a JSON row each."""
    runs.withColumn("created_at", F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) if "created_at" in runs.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return existing(spark, lambda: spark.read.schema(RUN).json(folder), RUN)


def run_of_sheet(runs: DataFrame, sheets: DataFrame, path: str = "path") -> DataFrame:
    """(path, run fields): per sheet the latest run that made it."""
    made = runs.select("*", F.explode("generated_harmonized").alias("__sheet"))
    w = Window.partitionBy(path).orderBy(F.desc("created_at"), F.desc("eval_report"))
    joined = sheets.select(path).distinct().join(made, F.col(path) == F.col("__sheet")).withColumn("__nth", F.row_number().over(w))
    return joined.where("__nth = 1").drop("__nth", "__sheet")


def related_sheets(sheets: DataFrame, path: str = "path") -> DataFrame:
    """(path, related): sheets of the same paper in the same folder, in order of their names; a sheet of no paper is alone."""
    folder = F.regexp_extract(path, "^(.*[/\\\\])?[^/\\\\]*$", 1)
    keyed = sheets.select(path, folder.alias("f"), sheet_pmid(path).alias("p"), sheet_table_number(path).alias("n")).distinct()
    of_paper = keyed.where("p != ''").groupBy("f", "p").agg(F.sort_array(F.collect_set(path)).alias("related"))
    return keyed.join(of_paper, ["f", "p"], "left").select(path, F.coalesce("related", F.array(path)).alias("related"))


def run_results(runs: DataFrame, sheet_rows: DataFrame, reasons: DataFrame, summary: DataFrame) -> DataFrame:
    """The view of runs: tables, rows that agree and that fail, and the row scores. sheet_rows(path, n), reasons(eval_report, reason, count) of unmatched predictions,
    summary(eval_report, row_precision, row_recall, row_f1)."""
    made = runs.select("eval_report", F.explode_outer("generated_harmonized").alias("path")).join(sheet_rows, "path", "left")
    total = made.groupBy("eval_report").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("path").alias("table_count"))
    failed = reasons.groupBy("eval_report").agg(F.sum("count").alias("failed_rows"), F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "reason", "count"))).alias("__r"))
    joined = runs.join(total, "eval_report", "left").join(failed, "eval_report", "left").join(summary, "eval_report", "left")
    lost = F.coalesce("failed_rows", F.lit(0))
    shown = F.transform("__r", lambda x: F.struct(x["reason"].alias("reason"), x["count"].alias("count")))
    return joined.select("pmid", "pmcid", "owner_name", "eval_report", "table_count", F.greatest(F.lit(0), F.col("total") - lost).alias("success_rows"), lost.alias("failed_rows"), shown.alias("predicted_issue_summary"), "row_precision", "row_recall", "row_f1")


def tracker_entries(results: DataFrame, current: DataFrame, paper_input: Column, table_links: Column, edit_path: Column) -> DataFrame:
    """Tracker entries of run results: in progress, with priority (medium by default), message and title of the entry there is."""
    old = current.select(F.col("pmid").alias("__pmid"), F.col("priority").alias("__priority"), F.col("message").alias("__message"), F.col("paper_title").alias("__title"))
    joined = results.join(old, F.col("pmid") == F.col("__pmid"), "left")
    keep = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return joined.select(
        "pmid", F.coalesce("pmcid", F.lit("")).alias("pmcid"), F.coalesce("owner_name", F.lit("")).alias("owner_name"), paper_input.alias("paper_input"), table_links.alias("table_links"), F.lit("in_progress").alias("status"),
        keep("__priority", "medium").alias("priority"), keep("__message", "").alias("message"), F.lit("").alias("run_log"), F.col("eval_report"), edit_path.alias("edit_path"), F.coalesce("table_count", F.lit(0)).cast("bigint").alias("table_count"), keep("__title", "").alias("paper_title"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of spark.checkpoint.dir; without that setting a temporary one, if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer has made the version that this one was to be."""


def log_path(folder: str, version: int) -> str:
    return f"{folder}/_log/{version:010d}"


def file_system(spark: SparkSession, folder: str):
    """(Hadoop file system of a folder, function that makes its paths)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file wasn't there and is now. On this machine's disks and on HDFS the file system itself decides between two writers; an object store must offer a conditional put."""
    fs, at = file_system(spark, path)
    local = re.sub(r"^file:/*", "/", path) if fs.getScheme() == "file" else None
    try:
        if local:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "x", encoding="utf-8") as f:
                f.write(text)
        else:
            out = fs.create(at(path), False)
            out.write(bytearray(text.encode()))
            out.close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    return True


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a stored table, ascending."""
    fs, at = file_system(spark, folder)
    log = at(f"{folder}/_log")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()) if fs.exists(log) else []


def data_of(spark: SparkSession, folder: str, version: int) -> str:
    """The folder of a version's rows, as its manifest says. A manifest that a writer is just filling is waited for."""
    for _ in range(100):
        said = "".join(r["value"] for r in spark.read.text(log_path(folder, version)).collect())
        if said.endswith("."):
            return f"{folder}/data/{said[:-1]}"
        time.sleep(0.05)
    raise ValueError(f"version {version} of {folder} was never finished")


def read_version(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> tuple[int, DataFrame]:
    """(version, rows) of a stored table, the latest if no version is named; (0, no rows) where there is none."""
    have = versions(spark, folder)
    if version is not None and version not in have:
        raise ValueError(f"{folder} has no version {version}")
    chosen = version if version is not None else max(have, default=0)
    return chosen, spark.read.parquet(data_of(spark, folder, chosen)) if chosen else spark.createDataFrame([], schema)


def commit(df: DataFrame, folder: str, after: int) -> int:
    """Writes rows as the version that follows `after`, if no other writer has: rows go to a folder of their own, and a manifest that is put if absent makes them the version."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/data/{name}")
    if not put_if_absent(df.sparkSession, log_path(folder, after + 1), name + "."):
        raise Conflict(f"{folder} has a version {after + 1} by another writer")
    return after + 1


def update(spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
    """A new version made by merge(rows of the latest). If another writer was faster, its version is read and merged anew, so no edit is lost. Returns the version."""
    for left in range(tries, 0, -1):
        version, rows = read_version(spark, folder, schema)
        try:
            return commit(merge(rows), folder, version)
        except Conflict:
            if left == 1:
                raise
    raise ValueError("tries must be positive")


def compact(spark: SparkSession, folder: str, keep: int = 10) -> int:
    """Removes all but the latest `keep` versions, and rows that no version names (of writers that lost or died; none may be writing now). Returns how many folders of rows went."""
    have = versions(spark, folder)
    kept = have[-keep:]
    named = {data_of(spark, folder, v).rsplit("/", 1)[-1] for v in kept}
    fs, at = file_system(spark, folder)
    for v in have[: len(have) - len(kept)]:
        fs.delete(at(log_path(folder, v)), False)
    data = at(f"{folder}/data")
    gone = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in named] if fs.exists(data) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)


ANNOTATIONS = "row_idx bigint, col string, status string, comment string, fingerprint string"


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of the changes in the place of those of equal keys. Columns that one side lacks are null."""
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(changes[k]) for k in keys])
    return rows.join(changes.select(*keys).distinct(), same, "left_anti").unionByName(changes, allowMissingColumns=True)


def save_tracker(entries: DataFrame, folder: str) -> int:
    """All entries anew; for edits beside other writers see edit_tracker."""
    return update(entries.sparkSession, folder, TRACKER, lambda _: entries)


def edit_tracker(changes: DataFrame, folder: str) -> int:
    """Entries added or replaced by pmid, whatever others write meanwhile."""
    return update(changes.sparkSession, folder, TRACKER, lambda rows: upserted(rows, changes, ["pmid"]))


def read_tracker(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return read_version(spark, folder, TRACKER, version)[1]


def save_annotations(annotations: DataFrame, folder: str) -> int:
    return update(annotations.sparkSession, folder, ANNOTATIONS, lambda _: annotations)


def edit_annotations(changes: DataFrame, folder: str) -> int:
    """Annotations added or replaced by row and column, whatever others write meanwhile."""
    return update(changes.sparkSession, folder, ANNOTATIONS, lambda rows: upserted(rows, changes, ["row_idx", "col"]))


def read_annotations(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return read_version(spark, folder, ANNOTATIONS, version)[1]


def write_csv(df: DataFrame, folder: str) -> None:
    """A folder of CSV files with headers."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def publication_rows(ranked: DataFrame) -> DataFrame:
    """The ranked list's columns, lists joined by "; "."""
    joined = {c: F.array_join(c, "; ").alias(c) for c in ("publication_types", "mesh_terms")}
    relevant = F.col("relevant").alias("is_alzheimers_relevant") if "relevant" in ranked.columns else F.col("is_alzheimers_relevant")
    return ranked.select(*[joined.get(c, relevant if c == "is_alzheimers_relevant" else F.col(c)) for c in PUBLICATIONS])


def write_validation(documents: DataFrame, folder: str) -> None:
    """Validation reports, one file for each paper: folder/paper=.../."""
    documents.repartition("paper").write.mode("overwrite").partitionBy("paper").text(folder)


def files_of(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, file_name, size, changed) of the files of a pattern; none where there are none."""
    found = existing(spark, lambda: spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed")), "path string, size bigint, changed timestamp")
    return found.select("path", base_name("path").alias("file_name"), "size", "changed")


def issue_files(files: DataFrame, pmid: int, scope: str, sheets: list[str]) -> DataFrame:
    """Of the files the combined mismatch list of a paper, else the lists of its sheets (base names)."""
    combined = f"pmid_{pmid}_mismatch_combined_inputs_{scope}.csv"
    own = [f"pmid_{pmid}_mismatch_{s}_{scope}.csv" for s in sheets]
    wanted = files.where(F.col("file_name").isin(combined, *own)).withColumn("__all", F.max(F.col("file_name") == combined).over(Window.partitionBy()))
    return wanted.where(~F.col("__all") | (F.col("file_name") == combined)).drop("__all")
