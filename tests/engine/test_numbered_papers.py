from pyspark.sql import functions as F

from litgrid.operators import enrich


def test_rows_of_a_paper_are_numbered_in_parts(spark):
    rows = [(1, i) for i in range(500)] + [(2, 5), (2, None), (2, 3), (None, 9), (None, 2)]
    df = spark.createDataFrame(rows, "paper int, k bigint").repartition(7).withColumns({"row_status": F.lit("success"), "row_issues": F.array(F.lit("x")), "checks": F.expr("map('a', struct('ok' as status, array('x') as issues))")})
    found = enrich.validation_rows(df, "paper", ["k"], "k")
    assert dict(found.dtypes)["row_index"] == "int"
    got = {(r["paper"], r["record_id"]): r["row_index"] for r in enrich.numbered_by_paper(df.withColumn("record_id", F.col("k")), "paper", ["k"], "row_index").collect()}
    assert got == {(1, i): i for i in range(500)} | {(2, None): 0, (2, 3): 1, (2, 5): 2, (None, 2): 0, (None, 9): 1}
    assert sorted(r[0] for r in found.where("paper = 1").select("row_index").collect()) == list(range(500))
    # no window over rows (over the small table of sizes only) has the paper alone as its key
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and "row_number()" in line]
    assert windows and all("__part" in line for line in windows)
