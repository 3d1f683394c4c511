import os

import pytest
from pyspark.sql import functions as F

from litgrid import api, incremental
from litgrid.sources import sheets, stores

PAPERS = [("30448613", "Methods\nWe used logistic regression in 12,345 participants of European ancestry."), ("30448614", "A meta-analysis."), ("7777777", "nothing")]
HEAD = "SNP,Chr,Position,Gene,OR,P value\n"
GOLD = "`Pubmed PMID` string, `Top SNP` string, `#dbSNP_hg38_chr` string, `P-value` string, OR_nonref string"


def papers(spark, rows=PAPERS):
    return spark.createDataFrame(rows, "paper_id string, text string")


def state(df, drop=()):
    return sorted(str(r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns) if c not in drop]).collect())


def names(df):
    return sorted(os.path.basename(r[0]) for r in df.collect())


def whole(spark, rows, sources):
    cells, _ = sheets.readable_tables(spark, sources)
    return state(api.curate(papers(spark, rows), api.of_papers(cells)))


def test_updates_read_what_is_new_and_give_a_whole_runs_rows(spark, tmp_path):
    src, settings = tmp_path / "in", api.Settings(str(tmp_path / "out"))
    src.mkdir()
    pattern = [str(src / "*.csv"), str(src / "*.xlsx")]
    (src / "30448613_a.csv").write_text(HEAD + "rs1,19,100,APOE,1.2,0.01\nrs2,2,200,BIN1,0.9,0.5\n")
    (src / "30448614_a b.csv").write_text(HEAD + "rs3,1,5,CR1,1.1,0.02\n")
    with open(src / "30448614_table2.xlsx", "wb") as f:
        f.write(sheets.workbook({"s": [HEAD.strip().split(","), ["rs4", "3", "7", "CLU", "1.5", "0.03"]]}))
    (src / "7777777.xlsx").write_bytes(b"broken")
    gold = spark.createDataFrame([("30448613", "rs1", "chr19", "0.01", "1.2"), ("30448614", "rs3", "chr1", "0.02", "1.1"), ("30448614", "rs9", "chr1", "0.5", "1")], GOLD)
    good = [str(src / "*.csv"), str(src / "30448614_table2.xlsx")]

    one = incremental.update(spark, papers(spark), pattern, settings, gold)
    assert names(one["extracted"]) == ["30448613_a.csv", "30448614_a%20b.csv", "30448614_table2.xlsx", "7777777.xlsx"]
    assert names(one["recurated"]) == ["30448613", "30448614", "7777777"] and names(one["source_errors"]) == ["7777777.xlsx"]
    assert one["curated"].where("TopSNP in ('rs1', 'rs2', 'rs3', 'rs4')").count() == 4
    first_scores = {(r["paper"], r["row_precision"], r["row_recall"]) for r in one["summary"].collect()}
    assert {s for s in first_scores if s[0] != "7777777"} == {("30448613", 0.5, 1.0), ("30448614", 0.5, 0.5)}

    two = incremental.update(spark, papers(spark), pattern, settings, gold)
    assert names(two["extracted"]) == [] and names(two["recurated"]) == [] and names(two["source_errors"]) == ["7777777.xlsx"] and state(two["curated"]) == state(one["curated"])

    # a new file, a touched one with its old content, one that is no more, a mended one, gold rows of another paper, and another text
    (src / "30448614_c.csv").write_text(HEAD + "rs9,1,9,PICALM,1,0.5\n")
    os.utime(src / "30448613_a.csv", (1, 1))
    (src / "30448614_a b.csv").unlink()
    (src / "7777777.xlsx").unlink()
    more = gold.unionByName(spark.createDataFrame([("30448613", "rs2", "chr2", "0.5", "0.9")], GOLD))
    rows = [*PAPERS[:2], (PAPERS[2][0], "HRC panel.")]
    three = incremental.update(spark, papers(spark, rows), pattern, settings, more)
    assert names(three["extracted"]) == ["30448614_c.csv"] and names(three["recurated"]) == ["30448614", "7777777"] and names(three["source_errors"]) == []
    assert state(three["curated"]) == (want := whole(spark, rows, good))
    assert {(r["paper"], r["row_precision"], r["row_recall"]) for r in three["summary"].collect() if r["paper"] != "7777777"} == {("30448613", 1.0, 1.0), ("30448614", 0.5, 0.5)}
    assert state(incremental.current(spark, settings, 1)) == state(one["curated"])
    assert incremental.compact(spark, settings) == 2 and state(incremental.current(spark, settings)) == want
    four = incremental.update(spark, papers(spark, rows), pattern, settings, more)
    assert names(four["extracted"]) == [] and names(four["recurated"]) == [] and state(four["curated"]) == want


def quick(papers, raw, *_):
    """In the stead of curation where it is not what is tested."""
    return raw.where("value like 'rs%'").select("paper_id", F.col("value").alias("TopSNP"))


def test_two_updates_at_once(spark, tmp_path, monkeypatch):
    settings = api.Settings(str(tmp_path / "out"))
    (tmp_path / "30448613.csv").write_text(HEAD + "rs1,19,100,APOE,1.2,0.01\n")

    def overtaken(*args):
        monkeypatch.setattr(api, "curate", quick)
        incremental.update(spark, papers(spark), [str(tmp_path / "*.csv")], settings)
        return quick(*args)

    monkeypatch.setattr(api, "curate", overtaken)
    with pytest.raises(stores.Conflict):
        incremental.update(spark, papers(spark), [str(tmp_path / "*.csv")], settings)
    assert [tuple(r) for r in incremental.current(spark, settings).collect()] == [("30448613", "rs1")]
    out = incremental.update(spark, papers(spark), [str(tmp_path / "*.csv"), str(tmp_path / "none.csv"), "x.pdf"], settings)
    assert names(out["extracted"]) == [] and names(out["source_errors"]) == ["none.csv", "x.pdf"]


def test_nothing_and_repeated_papers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "curate", quick)
    settings = api.Settings(str(tmp_path / "out"))
    assert incremental.update(spark, papers(spark, []), [], settings)["curated"].count() == 0
    with pytest.raises(ValueError, match="unique"):
        incremental.update(spark, papers(spark, PAPERS[:1] * 2), [], settings)


def test_the_query_reads_late_files_only(spark):
    from litgrid.plans import more_queries

    sf_dir = "/root/testdata/sf0.001"
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()]
    want = {}
    for k in keys:
        odd = k // 200 % 2 == 1
        if k % 3 != 2 or odd:
            want.setdefault(str(30_000_000 + k // 200), [set(), 0])[0].add(f"rs{k}")
        if k % 3 == 2 and odd:
            want[str(30_000_000 + k // 200)][1] = 1
    got = {r["paper_id"]: (r["n_records"], r["first_snp"], r["n_read"]) for r in more_queries.incremental_curation(spark, sf_dir).collect()}
    assert got == {p: (len(s), min(s), n) for p, (s, n) in want.items()}
