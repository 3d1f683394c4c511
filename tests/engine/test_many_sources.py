"""Many small sources: few tasks list them, and what follows from a path is worked out once for each table."""

from litgrid import api, incremental


def test_few_tasks_list_many_files(spark, tmp_path):
    for k in range(80):
        (tmp_path / f"{30448613 + k}_a.csv").write_text("SNP\nrs1\n")
    limit, before = max(32, 2 * spark.sparkContext.defaultParallelism), spark.conf.get(incremental.LISTING)
    spark.sparkContext.setJobGroup("many sources", "")
    try:
        with incremental.few_listing_tasks(spark):
            marks, failed = incremental.source_marks(spark, [str(tmp_path / "*.csv")], spark.createDataFrame([], incremental.MARKS), False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("many sources") for s in status.getJobInfo(j).stageIds]
    listing = [s.numTasks for s in stages if s and s.name.startswith("load")]
    assert listing and max(listing) <= limit and spark.conf.get(incremental.LISTING) == before
    assert not failed and marks.where("mark is not null and not known").count() == 80


def test_paths_are_parsed_by_table(spark):
    paths = ["/x/30448613_table4.xlsx", "/x/30448613_table4_b.csv", "/x/notes.csv"]
    rows = [(p, t, r, 0, f"{p}{t}{r}") for p in paths for t in range(2 if p.endswith("b.csv") else 1) for r in range(3)]
    raw = api.of_papers(spark.createDataFrame(rows, "path string, table_no int, row_idx int, col_idx int, value string"))
    got = {(r["table_id"], r["paper_id"], r["logical_no"], r["link"]) for r in raw.collect()}
    assert got == {("/x/30448613_table4.xlsx#0", "30448613", 4, "30448613_table4.xlsx"), ("/x/30448613_table4_b.csv#0", "30448613", 1, "30448613_table4_b.csv"), ("/x/30448613_table4_b.csv#1", "30448613", 2, "30448613_table4_b.csv"), ("/x/notes.csv#0", "NR", 1, "notes.csv")}
    assert sorted(r["value"] for r in raw.collect()) == sorted(r[4] for r in rows)
    # every expression on a path stands above the tables' aggregate, none above the join with the cells
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[: plan.index("Aggregate")].split("Join")[0] and "regexp_extract" in plan
