import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from litgrid import api
from litgrid.operators import align
from litgrid.plans import rules
from litgrid.sources import sheets, stores
from litgrid.streaming import landing

PAPER = "Intro\nMethods\nWe used logistic regression, adjusted for age, in 12,345 participants of European ancestry. HRC panel.\nResults\nA meta-analysis."
HEAD = ["SNP", "Chr", "Position", "Gene", "EA/OA", "OR (95% CI)", "P value", "Cohort"]


def raw(spark, rows, table=1, paper="30448613"):
    cells = [(table, r, c, v, paper) for r, row in enumerate([HEAD, *rows]) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "table_id int, row_idx int, col_idx int, value string, paper_id string")


def test_curate_and_evaluate(spark, tmp_path):
    papers = spark.createDataFrame([("30448613", PAPER), ("2", "nothing")], "paper_id string, text string")
    table = raw(spark, [["rs1a", "19", "100", "APOE", "C/T", "1.26 (1.1-1.4)", "4.2 x 10^-5", "ADGC"], ["rs2", "2", "200", "BIN1", "A/G", "0.9", "0.01", ""]])
    api.curate(papers, table).write.parquet(str(tmp_path / "curated"))
    curated = spark.read.parquet(str(tmp_path / "curated"))
    got = {r["RecordID"]: r for r in curated.collect()}
    assert set(got) == {"30448613_R00001", "30448613_R00002", "2_R00001"}
    one = got["30448613_R00001"]
    assert (one["TopSNP"], float(one["EffectSize(altvsref)"]), one["95%ConfidenceInterval"], one["Population"], one["Sample size"], one["Cohort"], one["Imputation_simple2"]) == ("rs1", 1.26, "(1.1-1.4)", "European ancestry", "12345", "ADGC", "HRC")
    assert (one["Model type"], one["Stage"], one["Meta/Joint"], one["TableIDX"], one["Table Ref in paper"], one["Pubmed PMID"]) == ("logistic regression (with covariates)", "Meta-analysis", "Meta", "T00001", "Table 1", "30448613")
    assert one["confidence"] == pytest.approx(0.4 * 0.4 + 0.4 * 0.25 + 0.2 * 0.9) and one["needs_review"]
    assert one["evidence"].startswith("Row text: rs1a | 19 | 100 | APOE") and "\n[Stage evidence] We used logistic" in one["evidence"] and "\n[Cohort evidence] row context matched cohort keyword -> ADGC\n" in one["evidence"]
    audited = {a["field"]: (a["confidence"], a["needs_review"]) for a in one["audit"]}
    assert list(audited) == ["Name", "P-value", "EffectSize(altvsref)", "Stage", "Model type", "Imputation_simple2", "Population", "Sample size", "Cohort"] and audited["Stage"] == (0.8, False) and audited["Cohort"] == (0.8, False)
    shell = got["2_R00001"]
    assert (shell["TopSNP"], shell["Stage"], shell["PaperIDX"], shell["confidence"]) == ("NR", "NR", "2", 0.25)
    gold = spark.createDataFrame([("30448613", "rs1", "chr19", "4.2e-5", "1.26"), ("30448613", "rs3", "chr1", "0.5", "1.0")], "`Pubmed PMID` string, `Top SNP` string, `#dbSNP_hg38_chr` string, `P-value` string, OR_nonref string")
    scores = api.evaluate(curated, gold, api.Settings("x"))["summary"].first()
    assert (scores["status"], scores["key_cols"], scores["n_pred_rows"], scores["n_gold_rows"]) == ("evaluated", "pmid,snp,chr,pvalue", 2, 2)
    assert (scores["row_precision"], scores["row_recall"], scores["row_f1"]) == (0.5, 0.5, 0.5)


def test_hints_fill_what_rows_and_text_do_not_tell(spark):
    papers = spark.createDataFrame([("35490390", "nothing")], "paper_id string, text string")
    table = raw(spark, [["rs1", "19", "100", "APOE", "C/T", "1.26", "4.2 x 10^-5", ""]], table=3, paper="35490390")
    hints = spark.createDataFrame(rules.PAPER_HINTS, "pmid string, table_idx int, field string, value string")
    one = api.curate(papers, table, hints).first()
    assert (one["Cohort"], one["Population"], one["Imputation_simple2"]) == ("Amish", "European ancestry", "HRC;1000G")


def test_run_writes_and_checks(spark, tmp_path):
    with open(tmp_path / "30448613_table2.xlsx", "wb") as f:
        f.write(sheets.workbook({"s": [HEAD, ["rs1", "19", "100", "APOE", "C/T", "1.2", "2.0", "x"]]}))
    for name in ("30448613_a.csv", "30448613_b.csv", "777777.csv"):
        (tmp_path / name).write_text("SNP,Chr,P value\nrs5,1,0.01\n")
    papers = spark.createDataFrame([("30448613", PAPER)], "paper_id string, text string")
    settings = api.Settings(str(tmp_path / "out"))
    out = api.run(spark, papers, [str(tmp_path / "30448613_table2.xlsx"), str(tmp_path / "*.csv")], settings)
    got = out["curated"].orderBy("paper_id", "TopSNP").collect()
    assert [(r["paper_id"], r["TopSNP"], r["TableIDX"]) for r in got] == [("30448613", "rs1", "T00002"), ("30448613", "rs5", "T00001"), ("30448613", "rs5", "T00001"), ("777777", "rs5", "T00001")]
    assert len({r["RecordID"] for r in got}) == 4 and len({r["table_id"] for r in got}) == 4
    assert {(r["row_status"], r["n"]) for r in out["validation_summary"].collect()} == {("failed", 1), ("warning", 3)}
    report = json.loads(spark.read.text(f"{settings.folder('validation')}/paper=30448613").first()[0])
    assert report["summary"] == {"success": 0, "warning": 2, "failed": 1} and report["schema_version"] == "self_validation_v1" and [r["row_index"] for r in report["rows"]] == [0, 1, 2]
    bad = next(r for r in report["rows"] if r["row_status"] == "failed")
    assert "P-value: p-value is outside 0-1" in bad["row_issues"] and bad["fields"]["P-value"]["status"] == "issue"
    logs = stores.read_runs(spark, settings.folder("runs"))
    assert logs.count() == 1 and stores.run_of_sheet(logs, spark.createDataFrame([(settings.folder("curated"),)], "path string")).first()["pmid"] == "30448613"
    with pytest.raises(ValueError, match="outside"):
        settings.folder("../else")


def test_evaluation_of_files(spark, tmp_path):
    names = ["Pubmed PMID", "TopSNP", "Chr", "P-value", "EffectSize(altvsref)", "Effect Size Type (OR or Beta)", "Cohort"]
    with open(tmp_path / "a.xlsx", "wb") as f:
        f.write(sheets.workbook({"curated": [names, [9, "rs1", 19, 1e-5, 0.5, "Beta", "B; a"], [9, "rs2", "X", "2 x 10^-3", 1.5, "OR", None]]}))
    (tmp_path / "b.csv").write_text("Pubmed PMID,TopSNP,Chr,P-value,Cohort,Cohort_simplified (no counts)\n9,rs3,chr3,0.5,zz,\n9,,1,0.1,,\n9,rs4,4,,q,q\n")
    (tmp_path / "gold.tsv").write_text("Pubmed PMID\tTop SNP\t#dbSNP_hg38_chr\tdbSNP_hg38_position\tRA 1(Reported Allele 1)\tP-value\tOR_nonref\tCohort_simple3\tPopulation_map\tSample size\tAnalysis group\n9\trs1\tchr19\t5\tA\t1e-5\t1.6\ta/b\tEU\t10\tAll\n9\trs9\tchr1\t6\tNA\t0.2\t2\t\t\t\t\n8\trs1\tchr19\t5\tA\t1e-5\t1.6\ta\t\t\t\n")
    settings = api.Settings(str(tmp_path / "out"))
    out = api.evaluate_files(spark, str(tmp_path / "gold.tsv"), [str(tmp_path / "a.xlsx"), str(tmp_path / "b.csv")], 9, settings)
    summary = {r["source_file"].rsplit("/", 1)[-1]: r for r in out["summary"].collect()}
    assert set(summary) == {"a.xlsx", "b.csv", "combined_inputs"}
    a, b, both = summary["a.xlsx"], summary["b.csv"], summary["combined_inputs"]
    assert (a["key_cols"], a["n_pred_rows"], a["n_gold_rows"], a["row_precision"], a["row_recall"]) == ("pmid,snp,chr,pvalue", 2, 2, 0.5, 0.5)
    assert (b["n_pred_rows"], b["row_precision"]) == (1, 0.0) and (both["n_pred_rows"], both["row_f1"]) == (3, 0.4)
    fields = {(r["source_file"].rsplit("/", 1)[-1], r["field"]): (r["tp"], r["fp"], r["fn"]) for r in out["fields"].collect()}
    assert fields["a.xlsx", "cohort"] == (1, 1, 1) and fields["a.xlsx", "effect"] == (0, 2, 2) and ("b.csv", "cohort") not in fields and ("a.xlsx", "bp") not in fields
    sets = {(r["source_file"].rsplit("/", 1)[-1], r["metric_set"]): r for r in out["sets"].collect()}
    assert sets["a.xlsx", "easy_fields"]["fields"] == "pvalue,effect,cohort,sample_size,analysis_group,population,chr"
    # of rs1 pvalue, cohort and chr agree, effect doesn't; rs2 has three values more, the gold side four and three
    assert (sets["a.xlsx", "easy_fields"]["precision"], sets["a.xlsx", "easy_fields"]["recall"]) == (3 / 7, 3 / 10)
    report = str(tmp_path / "out/evaluation/pmid_9_eval_report_like.xlsx")
    found = sheets.read_workbooks(spark, report)
    assert [r[0] for r in found.select("table_no", "name").distinct().orderBy("table_no").select("name").collect()] == ["gold", "predicted_all_tables", "missing_from_prediction", "extra_prediction", "summary", "field_accuracy"]
    assert {(r["reason"], r["snp"]) for r in out["extra"].collect()} == {("snp_not_in_gold", "rs2"), ("snp_not_in_gold", "rs3")} and {r["snp"] for r in out["missing"].collect()} == {"rs9"}
    read_again = sheets.read_reports(spark, report)
    assert {r["file"].rsplit("/", 1)[-1]: (r["status"], r["n_pred_rows"]) for r in read_again["summary"].collect()} == {"a.xlsx": ("evaluated", "2"), "b.csv": ("evaluated", "1"), "combined_inputs": ("evaluated", "3")}
    assert {(r["sheet"], r["reason"]): r["count"] for r in read_again["reasons"].collect()} == {("extra_prediction", "snp_not_in_gold"): 2, ("missing_from_prediction", "missing_in_prediction"): 1}
    assert {r["metric_set"] for r in read_again["field_accuracy"].collect()} == {"easy_fields", "all_fields"}
    alone = api.evaluate_files(spark, str(tmp_path / "gold.tsv"), [str(tmp_path / "b.csv")], 5, settings)["summary"].first()
    assert (alone["status"], alone["n_gold_rows"], alone["row_f1"], alone["key_cols"]) == ("not_in_gold", 0, None, "")
    chosen = align.report_summary(out["summary"]).first()
    assert (chosen["source_file"], chosen["pred_total"], chosen["fields"]) == ("combined_inputs", 3, ["pmid", "snp", "chr", "pvalue"])
    assert align.predicted_total(out["summary"], ["a.xlsx", "b.csv"]).first()[0] == 3


def test_discovery_scores_tables(spark):
    html = "<table><caption>Loci</caption><tr><td>Gene</td><td>P-value</td><td>OR</td></tr><tr><td>APOE</td><td>1e-8</td><td>1.2</td></tr></table><table><tr><td>Age</td></tr></table>"
    got = {r["table_no"]: (r["score"], r["selected"]) for r in api.discover_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert got == {0: (10, True), 1: (0, False)}
    article = "<table-wrap id='T0'></table-wrap><table-wrap id='T2'><label>Table 2</label><table><tr><td>Gene</td><td>P-value</td><td>OR</td></tr></table></table-wrap>"
    pages = spark.createDataFrame([(1, article, "PMC12")], "page_id long, html string, pmcid string")
    one = api.discover_tables(pages).first()
    assert (one["link"], one["table_index"]) == ("https://pmc.ncbi.nlm.nih.gov/articles/PMC12/table/T2/", 2)
    assert api.selected_links(pages) == [one["link"]] and api.selected_links(pages, ["x"]) == ["x"] and api.selected_links(pages, discover=False) == []


def test_ranking_with_a_profile(spark):
    article = lambda i, title, mesh: f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>{title}</ArticleTitle></Article><MeshHeadingList><MeshHeading><DescriptorName>{mesh}</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "xml string")
    got = api.rank(frame([article(1, "Cars", "Engines"), article(2, "Dementia genes", "Tau Proteins"), article(3, "Cars", "Roads")]), frame([article(9, "a", "Roads"), article(8, "b", "roads")])).collect()
    assert [(r["pmid"], r["score"], r["relevant"]) for r in got] == [("2", 11, True), ("3", 1, False), ("1", 0, False)]


def test_pages_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<table><tr><td>x</td></tr></table>")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    landing.into(landing.pages_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.where(F.col("value") != "")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['litgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
