import pytest
from pyspark.sql import functions as F

from litgrid.operators import cells, extract
from litgrid.plans import rules


def tables(spark, named):
    """{table_id: (headers, rows)} as cells and columns."""
    values = [(t, r, c, v) for t, (_, rows) in named.items() for r, row in enumerate(rows) for c, v in enumerate(row)]
    heads = [(t, c, h) for t, (hs, _) in named.items() for c, h in enumerate(hs)]
    return spark.createDataFrame(values, "table_id int, row_idx int, col_idx int, value string"), spark.createDataFrame(heads, "table_id int, col_idx int, name string")


GENERIC = (["SNP", "Chr", "Position", "Nearest gene", "EA/OA", "EAF", "OR", "95% CI", "P value"], [
    ["rs429358g", "19.0", "45411941", "APOEb", "C/T", "0.27", "1.26", "(0.83-1.92)", "4.2 x 10^-5"],
    ["", "", "", "", "", "", "1.5", "", "0.01"],
    ["Males only", "Males only", "Males only", "Males only", "Males only", "Males only", "Males only", "Males only", "Males only"],
    ["rs7; rs5", "2", "77", "BIN1", "A/G", "0.1", "0.9", "(0.8-1.0)", "1e-3"],
])


def test_generic_rows_carry_down_and_explode(spark):
    got = extract.records(*tables(spark, {1: GENERIC})).orderBy("row_idx", "name").select("row_idx", "name", "chrom", "bp", "ra1", "ra2", "effect", "ci", "p", "locus").collect()
    rows = [tuple(r) for r in got]
    assert [r[:2] for r in rows] == [(0, "rs429358"), (1, "rs429358"), (3, "rs5"), (3, "rs7")]
    assert rows[0][2:7] == ("19.0", "45411941", "C", "T", 1.26) and rows[0][7] == "(0.83-1.92)" and rows[0][8] == pytest.approx(4.2e-5)
    assert rows[1][2:6] == ("19.0", "45411941", "C", "T") and rows[1][9] == "APOE"
    assert rows[2][4:6] == ("A", "G")


def test_layouts_are_told_apart(spark):
    pipe = (["Exonic SNP | SNP | SNP", "Exonic SNP | ADGC a | OR (95% CI)", "Exonic SNP | ADGC a | P-value", "Gene"], [["rs11", "1.2 (1.0-1.4)", "0.01", "CLU"], ["x", "1", "1", "y"]])
    block = (["IGAP SNP", "Gene", "OR", "P", "Exonic SNP", "OR.1", "P.1", "OR.2", "P.2"], [["rs1", "G1", "1.1", "0.5", "rs2", "1.2", "0.4", "1.3", "0.3"], ["rs3", "in strong LD", "1", "1", "rs4", "1", "1", "1", "1"]])
    hazard = (["APOE4 stratification", "SNP (chr:pos)", "SNP (rs)", "N (CI)", "N (CU)", "Hazard ratio", "Hazard ratio 95% CI", "P-value", "Gene"], [["carriers", "2:77_A_G", "rs8", "10", "20", "1.5", "1.1;1.9", "0.02", "BIN1"]])
    survival = (["APOE4 stratification", "SNP", "Studies combined", "Number of observations", "Model", "Hazard Ratio", "Hazard Ratio 95 % CI", "P-value"], [["all", "rs9", "A+B", "100", "1", "2.0", "1.5;2.5", "1e-4"], ["", "", "", "", "2", "1.9", "1.4;2.4", "2e-4"]])
    inline = (["Variant", "Chr.", "Position", "Gene SYMBOL", "EA", "OR", "P", "OR.1", "P.1"], [["", "", "", "", "", "APOE*4+", "", "APOE*4-", ""], ["rs6", "1", "5", "CR1", "A", "1.1", "0.1", "0.9", "0.2"]])
    joint = (["Chr | Chr", "Position | Position", "Variant | Variant", "A1/A2a (MAF) | A1/A2a (MAF)", "Nearest gene | Nearest gene", "Cognitive domain | Cognitive domain", "Cohortsb | Cohortsb", "Genetic effects | βG (SE)", "Genetic effects | Pjoint"], [["3", "9", "rs12", "A/G (0.198)", "CLU", "Memory", "ADNI", "0.164 (0.04)", "3e-8"]])
    eqtl = (["IGAP SNP", "Closest gene", "Gene", "Probe set ID", "eQTL association beta", "eQTL association P", "AD association"], [["rs20", "CR1", "CR1L", "77", "0.3", "1e-4", "0.02"], ["", "", "CD46", "78", "0.1", "", "0.03"]])
    summary = (["eQTL", "Gene", "EA", "RA", "eSNP association summary a", "eSNP association summary b", "eSNP association summary c"], [["rs30", "CLU", "A", "G", "0.01 (0.5)", "0.02 (-0.1)", "Cortex"]])
    combination = (["Unnamed: 0_level_0 | Unnamed: 0_level_1", "Gene–gene combination | Gene–gene combination", "Genes included in the combination", "OR(95% CI.) | OR(95% CI.)", "P-value | one", "P-value | two"], [["APOE*4 carriers"] * 6, ["2", "rs1 x rs2", "A, B", "2.1 (1.1-3.1)", "0.01", "0.02"]])
    many = (["Chromosome", "SNP", "Gene", "EA", "RA", "EAF"] + [x for i in range(4) for x in (f"β value {i}", f"P value {i}")] + ["β value x", "P value x"] * 3, [["1", "rs40", "CR1", "A", "G", "0.2"] + ["0.5", "0.01"] * 7])
    wanted = {0: (pipe, 1), 1: (block, 3), 2: (survival, 2), 3: (hazard, 1), 4: (inline, 2), 5: (many, 7), 6: (combination, 2), 7: (joint, 1), 8: (eqtl, 3), 9: (summary, 2)}
    found = extract.records(*tables(spark, {k: t for k, (t, _) in wanted.items()})).cache()
    counts = {r["table_id"]: (r["layout"], r["n"]) for r in found.groupBy("table_id", "layout").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: (k, n) for k, (_, n) in wanted.items()}
    one = {r["table_id"]: r for r in found.orderBy("table_id", "row_idx").collect()}
    assert (one[3]["bp"], one[3]["ra1"], one[3]["ra2"], one[3]["ci"], one[3]["sample_size"]) == ("77", "G", "A", "(1.1, 1.9)", "10/20")
    assert (one[2]["name"], one[2]["cohort"], one[2]["model"]) == ("rs9", "A+B", "2")
    assert (one[7]["maf"], one[7]["effect"], one[7]["grp"]) == ("0.198", 0.164, "Memory | ADNI")
    assert one[6]["notes"] == "APOE*4 carriers" and one[8]["name"] == "rs20"
    assert {r["grp"] for r in found.where("table_id = 4").collect()} == {"APOE*4+", "APOE*4-"}
    sheet = extract.curated(found)
    assert sheet.columns == rules.CURATED_COLUMNS and sheet.count() == sum(n for _, n in wanted.values())


def test_subgroups_melt(spark):
    heads = ["SNP", "male group | OR", "male group | P", "female group | OR", "female group | P"]
    got = extract.records(*tables(spark, {1: (heads, [["rs1", "1.1", "0.1", "1.2", "0.2"], ["rs2", "", "", "1.4", "0.3"]])}))
    assert sorted((r["name"], r["grp"], r["effect"], r["p"]) for r in got.collect()) == [("rs1", "female group", 1.2, 0.2), ("rs1", "male group", 1.1, 0.1), ("rs2", "female group", 1.4, 0.3)]


def test_header_from_rows(spark):
    made, _ = tables(spark, {1: (["Unnamed: 0", "Unnamed: 1"], [["Table 1", ""], ["rsID", "P-value"], ["rs1", "0.1"]])})
    body, columns = cells.with_header(made)
    assert sorted((r["col_idx"], r["name"]) for r in columns.collect()) == [(0, "rsID"), (1, "P-value")]
    assert body.count() == 2
