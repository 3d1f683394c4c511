"""Papers and pages are read once by Python, however many answers are drawn from what it finds."""

from pyspark.sql import functions as F

from litgrid.operators import context, mentions


def python_reads(df):
    """How many times the plan of df names a read by Python, and how many kept results it uses."""
    plan = df._jdf.queryExecution().withCachedData().toString()
    return plan.count("MapInArrow"), plan.count("InMemoryRelation")


def test_papers_are_indexed_once(spark, monkeypatch):
    papers = spark.range(40).select(F.col("id").alias("paper_id"), F.lit("We use IGAP. Table 1 shows ADNI, ADNI.").alias("text"))
    records = papers.select("paper_id", F.lit("").alias("said"), F.lit("Table 1").alias("place"))
    found = context.record_cohorts(records, "said", "place", papers)
    reads, kept = python_reads(found)
    assert reads == kept == 3
    assert found.where("cohort_found.value = 'ADNI'").count() == found.count() == 40
    whole = sorted(map(str, mentions.index(papers.coalesce(1), "paper_id", "text", ["igap", "adni"]).collect()))
    monkeypatch.setattr(mentions, "OUT_ROWS", 3)
    assert sorted(map(str, mentions.index(papers.coalesce(1), "paper_id", "text", ["igap", "adni"]).collect())) == whole
    assert len(whole) == 160
