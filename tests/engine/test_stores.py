"""Stores: versions, paths, files and lists."""

import pytest
from pyspark.sql import functions as F

from litgrid.operators import literature
from litgrid.sources import stores


def test_versions_are_written_from_what_was_read(spark, tmp_path):
    folder = str(tmp_path / "tracker")
    assert stores.read_tracker(spark, folder).count() == 0
    entry = spark.createDataFrame([("7", "new"), ("8", "new")], "pmid string, status string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("pmcid", "string"), ("priority", "string"))])
    stores.save_tracker(entry, folder)
    for status in ("in_progress", "complete"):
        stores.save_tracker(stores.read_tracker(spark, folder).withColumn("status", F.when(F.col("pmid") == "7", status).otherwise(F.col("status"))), folder)
    assert sorted((r["pmid"], r["status"]) for r in stores.read_tracker(spark, folder).collect()) == [("7", "complete"), ("8", "new")]
    notes = spark.createDataFrame([(1, "Chr", "issue", "", "v1")], "row_idx bigint, col string, status string, comment string, fingerprint string")
    stores.save_annotations(notes, str(tmp_path / "notes"))
    assert [tuple(r) for r in stores.read_annotations(spark, str(tmp_path / "notes")).collect()] == [(1, "Chr", "issue", "", "v1")]


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "pmid string, status string")


def state(df):
    return sorted((r["pmid"], r["status"]) for r in df.collect())


def test_two_writers_at_once_lose_no_edit(spark, tmp_path):
    folder = str(tmp_path / "tracker")
    stores.edit_tracker(entries(spark, ("1", "new"), ("2", "new")), folder)
    seen = []

    def slow(rows):
        """A writer that is overtaken while it works on what it has read: twice."""
        seen.append(rows.count())
        if len(seen) < 3:
            stores.edit_tracker(entries(spark, (f"other{len(seen)}", "new"), ("2", f"by other {len(seen)}")), folder)
        return stores.upserted(rows, entries(spark, ("1", "complete")), ["pmid"])

    assert stores.update(spark, folder, stores.TRACKER, slow) == 4 and seen == [2, 3, 4]
    assert state(stores.read_tracker(spark, folder)) == [("1", "complete"), ("2", "by other 2"), ("other1", "new"), ("other2", "new")]
    assert state(stores.read_tracker(spark, folder, 1)) == [("1", "new"), ("2", "new")] and stores.versions(spark, folder) == [1, 2, 3, 4]
    with pytest.raises(stores.Conflict):
        stores.commit(entries(spark, ("x", "new")), folder, 2)
    with pytest.raises(ValueError, match="no version 9"):
        stores.read_tracker(spark, folder, 9)


def test_threads_that_edit_one_store(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "tracker")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: stores.edit_tracker(entries(spark, (str(i), "new")), folder), range(6)))
    assert sorted(made) == [1, 2, 3, 4, 5, 6] and state(stores.read_tracker(spark, folder)) == [(str(i), "new") for i in range(6)]


def test_compaction_keeps_the_latest_and_drops_rows_of_lost_commits(spark, tmp_path):
    folder = str(tmp_path / "tracker")
    for k in range(4):
        stores.edit_tracker(entries(spark, (str(k), "new")), folder)
    with pytest.raises(stores.Conflict):
        stores.commit(entries(spark, ("lost", "new")), folder, 1)
    assert stores.compact(spark, folder, keep=2) == 3  # two old versions' rows and the lost ones
    assert stores.versions(spark, folder) == [3, 4] and stores.read_tracker(spark, folder).count() == 4 and stores.read_tracker(spark, folder, 3).count() == 3
    assert stores.edit_tracker(entries(spark, ("9", "new")), folder) == 5


@pytest.mark.parametrize(("path", "want"), [("a/b", "/r/a/b"), ("/r/x", "/r/x"), ("a/../c", "/r/c")])
def test_paths_inside_the_root(path, want):
    assert stores.inside(path, "/r") == want


@pytest.mark.parametrize(("path", "root"), [("../x", "/r"), ("/other", "/r"), ("/rr/x", "/r"), ("s3://b/x", "/r"), ("s3://b/out/../x", "s3://b/out")])
def test_paths_outside_the_root_are_refused(path, root):
    with pytest.raises(ValueError, match="outside"):
        stores.inside(path, root)


def test_files_and_csv(spark, tmp_path):
    assert stores.files_of(spark, str(tmp_path / "none*")).count() == 0
    (tmp_path / "pmid_7_mismatch_a.xlsx_raw.csv").write_text("x")
    files = stores.files_of(spark, str(tmp_path / "*.csv"))
    assert [(r["file_name"], r["size"]) for r in stores.issue_files(files, 7, "raw", ["a.xlsx"]).collect()] == [("pmid_7_mismatch_a.xlsx_raw.csv", 1)]
    stores.write_csv(spark.createDataFrame([('a "q", b', 1)], "t string, n int"), str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()["t"] == 'a "q", b'


def test_default_query():
    base = '(("Alzheimer Disease"[MeSH Terms]) OR (alzheimer*[Title/Abstract])) AND ("gene"[Title] OR "genes"[Title] OR "genetics"[Title] OR "genetic*"[Title/Abstract]) AND NOT (Review[Publication Type])'
    assert literature.default_query() == base
    assert literature.default_query(2020) == base + ' AND ("2020"[Date - Publication])'
