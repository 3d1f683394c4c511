"""One paper may hold most rows: its rows never meet in one task."""

from pyspark.sql import functions as F

from litgrid.operators import align


def sides(spark, n):
    rows = spark.range(n).select(F.lit("p").alias("paper"), F.concat(F.lit("s"), F.col("id") % 2).alias("source_file"), F.concat(F.lit("rs"), F.col("id")).alias("snp"), F.when(F.col("id") % 10 == 0, "X").otherwise("1").alias("chr"), (F.col("id") % 7).cast("double").alias("pvalue"))
    few = spark.createDataFrame([("q", "only", "rs1", "1", 1.0), ("q", None, "rs1", "1", 1.0), ("r", "a", "rs2", "1", 2.0), (None, "a", "rs2", "1", 2.0)], "paper string, source_file string, snp string, chr string, pvalue double")
    gold = rows.withColumn("chr", F.lit("1")).drop("source_file").unionByName(spark.createDataFrame([("q", "rs1", "1", 1.0)], "paper string, snp string, chr string, pvalue double"))
    return rows.unionByName(few), gold


def test_rows_of_a_paper_are_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(align, "PART_ROWS", 200)
    pred, gold = sides(spark, 4_000)
    facts = spark.createDataFrame([("p", 1)], "paper string, known int")
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            joined = align.beside(gold, facts, ["paper"], 4_000, 1)
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sum(sizes) == 4_000
        assert max(sizes) <= 1_000


def test_scores_of_dealt_papers(spark, monkeypatch):
    found = {}
    for part_rows in (100, 100_000):
        monkeypatch.setattr(align, "PART_ROWS", part_rows)
        out = align.evaluate_sources(*sides(spark, 3_000))
        found[part_rows] = {k: sorted(map(str, df.collect())) for k, df in out.items()}
    assert found[100] == found[100_000]
    summary = {(r["paper"], r["source_file"]): r for r in out["summary"].collect()}
    assert set(summary) == {("p", "s0"), ("p", "s1"), ("p", align.COMBINED), ("q", "only"), ("r", "a")}
    assert [summary["p", s]["n_pred_rows"] for s in ("s0", "s1", align.COMBINED)] == [1_500, 1_500, 3_000]
    assert {summary["p", s]["n_gold_rows"] for s in ("s0", "s1", align.COMBINED)} == {3_000}
    assert abs(summary["p", align.COMBINED]["row_precision"] - 0.9) < 1e-12
    # s0 holds all rows of another chromosome: 300 of its 1,500
    assert abs(summary["p", "s0"]["row_precision"] - 0.8) < 1e-12
    assert summary["q", "only"]["row_f1"] == 1.0
    assert (summary["r", "a"]["status"], summary["r", "a"]["row_f1"]) == ("not_in_gold", None)
