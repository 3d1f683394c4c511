import math
import re

import pytest
from pyspark.sql import functions as F

from litgrid.functions import links as lk
from litgrid.functions import numbers as num
from litgrid.functions import text as tx
from litgrid.operators import align, cells, context, enrich, headers, scoring
from litgrid.plans import rules


def each(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("make", "pairs"),
    [
        (num.safe_float, {"4.2 x 10^-5": 4.2e-5, "-4.2 x 10^-5": 4.2e-5, "1e-5": 1e-5, "5×10−8": 5e-8, "n.s.": None, None: None, "3 * 10 8": 3e8, "P=2 x 10^-3 *": 2e-3, "rs110103": None, "ns 2100": None, "p=0.1035 ns": None, "4 X 10^-5": 4e-5, "- 5": -5.0}),
        (num.norm_num, {"-4.2 x 10^-5": -4.2e-5, "19.0": 19.0, "1_000": 1000.0, "_1": None, "1__0": None, "1_": None, "inf": float("inf"), "-Infinity": float("-inf"), "info": None, "abc": None, None: None, "0.1234567890123456": 0.123456789012, "4 X 10^-5": 4e-5, "1 e -5": 1e-5, "1 e-5": 1e-5, "+2x10^3": 2000.0}),
        (num.effect_of, {"1.26 (0.83-1.92)": 1.26, "0.164 (0.04)": 0.164, "−0.5": -0.5, "": None, "4.2x10-5": 4.2}),
        (lambda c: num.interval_of(c, F.lit("OR")), {"1.26 (0.83-1.92)": "(0.83-1.92)", "1.2 (0.1)": "", "x": ""}),
        (lambda c: num.interval_of(c, F.lit("Beta")), {"0.164 (0.04-0.1)": ""}),
        (num.p_of_pair, {"0.01 (0.5)": 0.01, "": None}),
        (num.beta_of_pair, {"0.01 (-0.5)": -0.5, "0.01": None}),
        (lambda c: F.concat_ws("|", *num.minor_major(c)), {"C/A": "A|C", "G / T": "T|G", "C": "|"}),
        (lambda c: F.concat_ws("|", *num.alleles_and_frequency(c)), {"A/G (0.198)": "A|G|0.198", "A/G": "A|G|", "x": "||"}),
        (lambda c: F.concat_ws("|", *num.chromosome_position(c, F.lit(""))), {"20:45269867": "20|45269867", "20:45_A_G": "20|45", "chr1": "chr1|"}),
        (lambda c: F.concat_ws("|", *num.location_alleles(c)), {"2:77_a_G": "2|77|G|A", "2:77": "|||"}),
        (tx.norm_snp, {"rs7920721g": "rs7920721", " RS1 ": "rs1", "gene": "gene", "": None}),
        (tx.norm_chr, {"chr19": "19", "19.0": "19", "X": "x", " ": None}),
        (tx.token_set, {"B/A, a": "a;b", ";": None, None: None}),
        (tx.strip_footnote, {"APOE cluster b": "APOE cluste b", "rs1a": "rs1"}),
        (tx.sanitize_topsnp, {"rs1a / RS2b": "rs1/rs2", "rs5 x": "rs5", "n/a": "", "GENEb": "GENE"}),
        (tx.sanitize_locus, {"APOEb, , BIN1": "APOE, BIN1"}),
        (tx.integer_like, {"19.0": "19", "1e3": "1000", "x": "x", "1.5": "1.5", "NA": ""}),
        (tx.cell, {"n/a": "", " a\nb ": "a b", None: "", "NR": "NR", "None": ""}),
        (tx.looks_missing, {"-": True, "nr": True, "x": False, "": True}),
        (tx.is_missing_value, {"-": False, "NR": True, "nan": True}),
        (tx.normalize, {" A  B\n": "a b", None: ""}),
        (tx.cohort_codes, {"the ADGC; hrs/unknown": "ADGC;HRS", "none": "NR", "x, adsp": "ADSP"}),
        (tx.imputation_codes, {"1000 Genomes and HRC": "HRC;1000G", "x": "NR", "TOPMed;x": "TOPMed"}),
        (tx.meta_or_joint, {"Meta-analysis": "Meta", "joint": "Joint", None: "NR"}),
        (tx.table_number, {"T07": 7, "x-t3": 3, "https://a/table/T2/": 2, "nothing": None, "table 12": 12}),
        (tx.leading_pmid, {"30448613_table1.xlsx": "30448613", "/a/b/123.csv": None}),
        (tx.pmcid, {"77": "PMC77", "pmc8": "PMC8", "x": "x"}),
        (tx.article_id, {"https://x/articles/pmc12/": "PMC12", "x": None}),
        (tx.safe_name, {"(a b)": "a_b"}),
        (tx.flag, {"Yes": True, "0": False}),
        (tx.percent, {"0.1234": "12.3%", "x": "NA"}),
        (num.is_neg_log, {"-log10(P)": True, "P": False, "−log10(p)": True}),
        (lambda c: headers.p_value_tier(c), {"Meta P": 1, "P joint": 2, "P value all": 3, "p": 4, "het P": None, "x P-value": 5, "-log10 P": 6, "P GxAge": 7, "pf": None}),
        (headers.effect_type, {"β": "Beta", "OR (95% CI)": "OR", "HR": "HR", "Z score": "Zscore", "N": "NR"}),
        (lambda c: context.stage(c)["value"], {"A meta-analysis": "Meta-analysis", "pooled": "Joint-analysis", "stage 1 only": "Stage 1/2", "validate": "Replication/Validation", "a gwas": "Discovery", "nothing": "NR"}),
        (lambda c: context.model_type(c)["value"], {"logistic, adjusted": "logistic regression (with covariates)", "mixed model": "mixed regression", "only sex": "model with covariates (family NR)", "x": "NR"}),
        (lambda c: context.imputation(c)["value"], {"1000genomes and TOPMed": "1000G;TOPMed", "hrc": "HRC", "x": "NR"}),
        (lambda c: F.concat_ws("|", context.imputation(c)["evidence"], context.imputation(c)["rule"]), {"the hrc": "the hrc|panel keyword detection (TOPMed/HRC/1000G)", "x": "|no imputation keywords found"}),
        (lambda c: context.association_type(c)["evidence"], {"by MRI\nscan": "by MRI scan", "x": ""}),
        (lambda c: F.concat_ws("|", *[context.publication_ids(c)[k] for k in ("pmcid", "pmid", "evidence")]), {"PMCID: PMC12345 and PMID 1234567": "PMC12345|1234567|PMCID: PMC12345 and PMID 1234567", "see pmc9999": "PMC9999|NR|see pmc9999", "x": "NR|NR|"}),
        (lambda c: context.population(c)["value"], {"Europeans and Asians": "European ancestry", "trans-ethnic": "Multi-ethnic", "": "NR"}),
        (lambda c: context.sample_size(c)["value"], {"N = 12,345": "12345", "1,234 cases": "1234", "12 cases": "NR"}),
        (lambda c: scoring.table_score(c)[0], {"Gene P-value OR": 10, "number of genes": -1, "Age": 0}),
        (lambda c: F.array_join(context.snippets(c, ["b", "Z"], 3, 8), "|"), {"aaaabaaaa": "aaabaaa", "none": "", "b......b": "b...|...b", "zb": "zb"}),
        (lambda c: enrich.cell_check("P-value", c)["status"], {"2": "issue", "1e-5": "ok", "": "issue"}),
        (lambda c: enrich.cell_check("Chr", c)["status"], {"X": "ok", "23": "review", "NR": "review", "chr19": "ok", "19.0": "ok", "MT": "ok"}),
        (lambda c: enrich.cell_check("TopSNP", c)["status"], {"gene": "issue", "rs1; rs2": "ok", "": "issue", "rs7": "ok"}),
        (lambda c: enrich.cell_check("RA 1(Reported Allele 1)", c)["status"], {"A/G": "ok", "AC": "review", "t": "ok", "": "review"}),
        (lambda c: F.array_join(enrich.cell_check("P-value", c)["issues"], ","), {"x": "p-value is not numeric", "2": "p-value is outside 0-1", "NR": "missing required value", "0.5": ""}),
        (lambda c: F.concat_ws("|", lk.article_and_table(c)["pmcid"], lk.article_and_table(c)["table_id"]), {"https://x/articles/pmc12/table/T2/": "PMC12|T2", "/articles/PMC3": "PMC3", "x": ""}),
        (lambda c: lk.table_link(c, F.lit("PMC1")), {"/articles/PMC1/table/T1": f"{lk.SITE}/articles/PMC1/table/T1/", "table/x#y": f"{lk.SITE}/articles/PMC1/table/x/", "/table/z/?q": f"{lk.SITE}/articles/PMC1/table/z/", "/articles/PMC2/table/T1/": None, "": None}),
        (lambda c: lk.article_page(c, F.lit("PMC1")), {"http://a/articles/pmc1/": "http://a/articles/pmc1/", "x": f"{lk.SITE}/articles/PMC1/"}),
        (lambda c: lk.link_table_number(c, F.lit(9)), {"/articles/PMC1/table/T3/": 3, "/table/a-tbl-02": 2, "x?table_id=T4": 4, "/table/q-T5/": 5, "x": 9}),
        (lk.id_table_number, {"T02": 2, "tbl3": 3, "x-t4": 4, "a5": 5, "x": None}),
        (lk.special_page_id, {"awz206-T1": True, "at1": True, "1": False, "": False}),
        (lk.sheet_pmid, {"/a/from_12_table3_v1.xlsx": "12", "x": ""}),
        (lk.sheet_table_number, {"from_12_table3_v1.xlsx": 3, "x": 1}),
        (lambda c: lk.editor_value("P-value", c), {"0.000012345678": "1.23457e-05", "0.5": "0.5", "1e-300": "1e-300", "1234567": "1.23457e+06", "x": "x", "100000": "100000", "0.00012": "0.00012", None: "", "12.50": "12.5"}),
        (lambda c: lk.safe_tag(c), {"a b/c": "a_b_c", "": "run", None: "run"}),
        (lambda c: lk.joined_levels(F.split(c, ";")), {"A; nan;B ": "A | B", ";": ""}),
        (lambda c: F.map_values(lk.link_numbers(F.split(c, ","))), {"/table/T2,/table/T1,/table/T2/": ["/table/T1", "/table/T2/"]}),
    ],
)
def test_scalars(spark, make, pairs):
    for value, got, want in zip(pairs, each(spark, list(pairs), make), pairs.values(), strict=True):
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, value


def test_headers_map_to_the_most_similar_prompt(spark):
    """Against a plain version: the larger of the matching-blocks ratio and the word Jaccard, over the levels of a header and all prompts in order."""
    from difflib import SequenceMatcher

    names = ["SNP", "P value", "Chr | Position", "meta P | zzz", "Nearest gene", "EAF", "qqqq", "Effect (OR)", "95% CI", "|", "Sample size"]
    norm = lambda t: " ".join(t.split()).lower()

    def words(t):
        t = norm(t)
        for short, long in rules.ABBREVIATIONS.items():
            t = re.sub(rf"(?i)\b{short}\b", long, t)
        return set(re.findall(r"[a-z0-9]+", t))

    want = {}
    for name in names:
        best = (0.0, "UNMAPPED", "")
        for option in [p.strip() for p in name.split("|") if p.strip()] if "|" in name else [name]:
            for target, about in rules.COLUMN_PROMPTS.items():
                prompt = f"{target}: {about}"
                a, b = words(option), words(prompt)
                score = max(SequenceMatcher(None, norm(option), norm(prompt)).ratio(), len(a & b) / len(a | b) if a and b else 0.0)
                if score > best[0]:
                    best = (score, target, option)
        want[name] = (best[1] if best[0] >= 0.4 else "UNMAPPED", round(best[0], 4), best[0] < 0.4, best[2])
    want.pop("|")  # no level, no row
    got = {r["name"]: (r["mapped"], r["score"], r["needs_review"], r["hint"]) for r in headers.map_to_prompts(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_missing_text_matches_and_missing_numbers_do_not(spark):
    rows = [("rs1", None, None), ("rs1", None, None), ("rs1", "1", 0.5), ("rs1", "1", math.nan), ("rs2", None, 0.1)]
    df = spark.createDataFrame(rows, "snp string, chr string, p double")
    got = align.row_match(df, df, ["snp", "chr"]).first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"]) == (5, 0, 0, 1.0)
    got = align.row_match(df, df, ["snp", "chr", "p"]).first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 3, 3)


def test_bag_identities_and_diagnosis(spark):
    pred = spark.createDataFrame([(1, "a", "1"), (2, "a", "1"), (3, "a", "2"), (4, "z", None)], "i int, snp string, chr string")
    gold = spark.createDataFrame([(1, "a", "1"), (2, "b", None)], "i int, snp string, chr string")
    b = align.row_match(pred, gold, ["snp", "chr"]).first()
    assert b["tp"] + b["fp"] == 4 and b["tp"] + b["fn"] == 2
    got = {(r["type"], r["i"]): r["reason"] for r in align.diagnose(pred, gold, ["snp", "chr"], "i").collect()}
    assert got == {("pred_unmatched", 2): "key_mismatch", ("pred_unmatched", 3): "chr_mismatch", ("pred_unmatched", 4): "snp_not_in_gold", ("gold_unmatched", 2): "missing_in_prediction"}


def test_forward_fill_is_idempotent(spark):
    df = spark.createDataFrame([("t", 1, None), ("t", 2, "a"), ("t", 3, None), ("u", 1, None)], "t string, i int, v string")
    once = cells.forward_fill(df, "t", "i", ["v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, cells.forward_fill(once, "t", "i", ["v"]).collect()))
    assert {(r["t"], r["i"]): r["v"] for r in once.collect()} == {("t", 1): None, ("t", 2): "a", ("t", 3): "a", ("u", 1): None}


def test_sections_double_what_comes_before_a_heading(spark):
    docs = spark.createDataFrame([(1, "Intro\nMethods\na\nRESULTS\nb"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["section"]): r["content"] for r in context.sections(docs).collect()}
    assert got == {(1, "methods"): "a", (1, "results"): "b", (1, "all"): "Intro\nIntro\na\nb"}
    assert {r["doc_id"]: r["scope"] for r in context.scoped(context.sections(docs)).collect()} == {1: "a\nb"}


def test_cohorts_by_row_then_table_then_text(spark):
    body = "Data of ADGC. " + "x" * 3000 + " Table 1 shows IGAP and IGAP. " + "y" * 3000 + " ADGC ADGC ADGC"
    rows = [(1, "from adni", body, "Table 1"), (2, "", body, "Table 1"), (3, "", body, "Table 9"), (4, None, "HRS once", "Table 1"), (5, "", None, None)]
    df = spark.createDataFrame(rows, "i int, own string, body string, tab string")
    rows += [(6, "adni of adgc", "", ""), (7, "an eqtl row", "HRS once", ""), (8, "ad association", None, None), (9, "", "ADGC and IGAP", "")]
    df = spark.createDataFrame(rows, "i int, own string, body string, tab string")
    got = {r["i"]: (r["cohort_found"]["value"], r["cohort_found"]["confidence"], r["cohort_found"]["needs_review"]) for r in context.record_cohorts(df, "own", "tab", df.select("i", "body"), "i", "body").collect()}
    assert got == {1: ("ADNI", 0.9, False), 2: ("IGAP", 0.8, False), 3: ("ADGC;IGAP", 0.45, True), 4: ("HRS", 0.6, True), 5: ("NR", 0.25, True), 6: ("ADGC;ADNI", 0.65, True), 7: ("HRS;ADNI", 0.45, True), 8: ("IGAP", 0.6, True), 9: ("ADGC;IGAP", 0.45, True)}


def test_snippets_query_keeps_eight_wide_ones(spark, tmp_path):
    from litgrid.plans import queries

    text = " ".join(f"{i:03d} " + f"w{i} " * 80 + "password" for i in range(10))
    spark.createDataFrame([(1, text), (2, "none")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["first"]) for r in queries.snippets(spark, str(tmp_path)).collect()}
    at = text.index("password")
    assert got == {1: (8, text[at - 240 : at + 8 + 240]), 2: (0, "")}
