"""Registered queries of addresses, findings, evaluation reports, review and stores, over the driver's tables; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid import api, incremental
from litgrid.functions import links as lk
from litgrid.functions import text as tx
from litgrid.operators import align, cells, context, enrich, extract, gold, headers, review
from litgrid.plans import rules
from litgrid.plans.queries import diagnose_unmatched, faulty, gold_orders, pred_orders, publications, read, spread
from litgrid.sources import elements, html_tables, sheets, stores, workbooks


def table_addresses(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key, odd = F.col("c_custkey").cast("string"), F.col("c_custkey") % 2 == 1
    pmcid = F.concat(F.lit("PMC"), key)
    link = F.when(odd, F.concat(F.lit("/articles/"), F.lower(pmcid), F.lit("/table/T0"), key, F.lit("#x"))).otherwise(F.concat(F.lit("table/a-tbl-"), key, F.lit("/?q=1")))
    absolute = lk.table_link(link, pmcid)
    return c.select(
        "c_custkey", absolute.alias("link"), lk.article_and_table(absolute)["table_id"].alias("table_id"), lk.link_table_number(absolute, F.lit(0)).alias("number"), lk.table_page(pmcid, F.when(odd, key)).alias("page"), lk.article_page(F.when(odd, F.lit("x")).otherwise(F.concat(F.lit("http://a/articles/"), pmcid)), pmcid).alias("article"),
        lk.special_page_id(F.concat(F.when(odd, "a-T").otherwise(""), key)).alias("special"), lk.id_table_number(F.concat(F.lit("Tab0"), key)).alias("id_number"), lk.sheet_pmid(F.concat(F.lit("out/from_"), key, F.lit("_table3_v1.xlsx"))).alias("sheet_pmid"), lk.sheet_table_number(F.concat(F.lit("from_1_table"), key, F.lit("_v2.xlsx"))).alias("sheet_number"),
        lk.safe_tag(F.when(odd, "").otherwise("a b")).alias("tag"), tx.is_url(F.when(odd, "HTTPS://x").otherwise("ftp://x")).alias("is_url"), tx.article_url(F.when(odd, key).otherwise(""), "s/").alias("site"), tx.percent(F.concat(F.lit("0."), F.lpad(key, 5, "0"), F.lit("1"))).alias("percent"),
    )


def editor_values(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", lk.editor_value("P-value", F.concat(F.col("l_linenumber"), F.when(F.col("l_orderkey") % 2 == 0, ".2500").otherwise("25e-9"))).alias("p"), lk.editor_value("Chr", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))).alias("chr"))


def source_numbers(spark, sf_dir):
    """Sources of one table take the number of their paper or name, others that of their place."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus is not null")
    path = F.concat(F.lit("dir/table_"), F.col("o_custkey"), F.lit(".xlsx"))
    found = o.select(path.alias("path"), F.col("o_orderkey").alias("table_no"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.col("o_custkey"), F.lit("_table77"))).otherwise("x").alias("paper_id"))
    return sheets.logical_numbers(found)


def header_levels(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    levels = F.array(F.lit(" Group "), F.when(F.col("n_nationkey") % 2 == 0, "nan").otherwise(F.col("n_name")), F.lit(""), F.lit("P"))
    return n.select("n_nationkey", lk.joined_levels(levels).alias("name"))


def publication_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("See PMC99 and PMCID: PMC"), F.col("doc_id") + 10000)).otherwise("No"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("; PubMed "), F.col("doc_id") + 1000000)).otherwise(""))
    return d.select("doc_id", context.publication_ids(body).alias("x")).select("doc_id", "x.*")


def paper_findings(spark, sf_dir):
    """Findings of whole texts that say little, with what the metadata fill in."""
    d = read(spark, sf_dir, "documents")
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, "A meta-analysis of Europeans, N = 5000. ").otherwise("Zzz. "), F.when(F.col("doc_id") % 3 == 0, "Cox, with HRC.").otherwise("qqq"))
    hints = spark.createDataFrame([(str(i), None, "Imputation_simple2", "TOPMed") for i in range(0, 50)], "pmid string, table_idx int, field string, value string")
    c = context.paper_context(d.select("doc_id", said.alias("text")), hints=hints)
    out = [F.concat_ws("|", f"{f}.value", F.format_string("%.2f", f"{f}.confidence"), f"{f}.rule", f"{f}.evidence", F.col(f"{f}.needs_review").cast("string")).alias(f) for f in ("imputation", "stage", "association", "model", "population", "sample_size")]
    return c.select("doc_id", *out)


def cohort_of_rows(spark, sf_dir):
    c = spread(read(spark, sf_dir, "customer").select("c_custkey"))
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, "We use IGAP. Table 1 shows ADNI, ADNI.").when(k % 3 == 1, "Data of the HRS.").otherwise("")
    rows = c.select("c_custkey", F.when(k % 4 == 0, "of ADGC").when(k % 4 == 1, "eQTL").otherwise("").alias("said"), F.lit("Table 1").alias("place"))
    papers = c.select("c_custkey", F.concat(body, F.lit(" "), (k % 7).cast("string")).alias("text"))
    found = context.record_cohorts(rows, "said", "place", papers, "c_custkey")
    return found.select("c_custkey", F.col("cohort_found.value").alias("value"), F.col("cohort_found.confidence").alias("confidence"), F.col("cohort_found.needs_review").alias("review"))


def validation_issues(spark, sf_dir):
    f = faulty(spark, sf_dir).withColumn("evidence", F.when(F.col("o_orderkey") % 2 == 0, "P-value 2 of row").otherwise("row"))
    checked = enrich.validated(f, row_evidence=F.col("evidence"))
    rows = enrich.validation_rows(checked.withColumn("paper", F.col("o_orderkey") % 50), "paper", ["o_orderkey"], "o_orderkey")
    return rows.select("row_index", F.col("record_id").cast("string").alias("record_id"), "row_status", F.array_join(F.slice("row_issues", 1, 2), ";").alias("first_issues"), F.size("row_issues").alias("n_issues"), F.size("fields").alias("n_fields"), F.element_at("row_issues", -1).alias("last_issue"))


def rendered_records(spark, sf_dir, side):
    """Orders as a gold file or as a curated sheet writes them."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    shared = [F.when(k % 3 == 0, F.concat(k % 7 + 1, F.lit(" x 10^-"), k % 5 + 1)).otherwise(F.concat(F.lit("0.0"), k % 7 + 1)).alias("P-value"), F.when(k % 4 == 0, "NA").otherwise(F.concat(F.lit(" a"), F.lit("/B, a"))).alias("Population_map"), F.col("o_custkey").cast("string").alias("Sample size"), F.when(k % 6 == 0, "").otherwise(F.lower("o_orderstatus")).alias("RA 1(Reported Allele 1)"), F.col("o_orderpriority").alias("Analysis group")]
    if side == 1:
        return o.select(F.lit("77.0").alias("Pubmed PMID"), F.concat(F.lit("RS"), k, F.lit("g")).alias("Top SNP"), F.concat(F.lit("chr"), k % 22 + 1).alias("#dbSNP_hg38_chr"), k.cast("string").alias("dbSNP_hg38_position"), F.lit("1.5").alias("OR_nonref"), F.lit("x").alias("Cohort_simple3"), *shared)
    return o.select(F.lit("77").alias("Pubmed PMID"), F.concat(F.lit("rs"), k).alias("TopSNP"), F.concat(k % 22 + 1, F.lit(".0")).alias("Chr"), k.cast("string").alias("BP(Position)"), F.lit("0.5").alias("EffectSize(altvsref)"), F.when(k % 2 == 0, "Beta").otherwise("OR").alias(gold.EFFECT_TYPE), F.lit("Y;x").alias("Cohort"), *shared)


def digits_rounded(df):
    """Numbers to nine digits, so that engines agree."""
    return df.select(*[F.format_string("%.8e", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def gold_canonical(spark, sf_dir):
    return digits_rounded(gold.canonical_gold(gold.of_paper(rendered_records(spark, sf_dir, 1), 77)))


def predicted_canonical(spark, sf_dir):
    return digits_rounded(gold.canonical_predicted(rendered_records(spark, sf_dir, 2)))


def gold_papers(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return gold.papers(o.select(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.col("o_custkey"), F.lit(".0"))).alias("Pubmed PMID")))


def evaluated(spark, sf_dir):
    """Weak extractions of orders, a source for each priority, against the orders of two of three papers."""
    paper = (F.col("id") % 3).cast("int")
    named = lambda df: df.select(paper.alias("paper"), "snp", "chr", "bp", "ra1", "id", F.col("price").cast("double").alias("pvalue"))
    pred = named(pred_orders(spark, sf_dir)).withColumn("source_file", F.concat(F.lit("s"), F.col("id") % 2)).withColumn("ra1", F.when(F.col("source_file") == "s0", F.col("ra1"))).drop("id")
    return align.evaluate_sources(pred, named(gold_orders(spark, sf_dir)).where("paper < 2").drop("id"), ignored=("bp",))


def rounded_scores(df, *names):
    return df.select(*[c for c in df.columns if c not in names], *[F.round(c, 9).alias(c) for c in names])


def evaluation_summary(spark, sf_dir):
    return rounded_scores(evaluated(spark, sf_dir)["summary"], "row_precision", "row_recall", "row_f1")


def evaluation_fields(spark, sf_dir):
    return rounded_scores(evaluated(spark, sf_dir)["fields"], "precision", "recall", "f1")


def evaluation_sets(spark, sf_dir):
    return rounded_scores(evaluated(spark, sf_dir)["sets"].where("metric_set = 'easy_fields'"), "precision", "recall", "f1")


def evaluation_view(spark, sf_dir):
    return align.report_summary(evaluated(spark, sf_dir)["summary"]).select("paper", "source_file", "status", "pred_total", F.size("fields").alias("n_fields"))


def golden_rows(spark, sf_dir):
    papers = [(k, f"PMC{k}") for k in range(1, 40)]
    made = rendered_records(spark, sf_dir, 1).withColumn("Pubmed PMID", F.regexp_extract("dbSNP_hg38_position", "(\\d{2})$", 1)).withColumnRenamed("Population_map", "Population_map")
    found = gold.golden_tables(made, papers)
    return found.groupBy("table_name").agg(F.count("*").alias("n"), F.max("row").alias("last"), F.min("SNP").alias("first_snp"), F.min("Chr").alias("first_chr"))


def golden_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = c.select(F.concat(k, F.when(k % 3 == 0, "_PMC").otherwise("_"), k, F.when(k % 5 == 0, ".txt").when(k % 2 == 0, ".csv").otherwise(".xlsx")).alias("file_name"))
    listed = c.where(k % 4 != 0).select(F.concat(k, F.lit("_PMC"), k, F.lit(".csv")).alias("file_name"))
    return gold.name_faults(names, listed)


def golden_columns(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    golden = o.select((F.col("o_orderkey") % 10).cast("string").alias("table_name"), F.concat(F.lit("rs"), F.col("o_custkey")).alias("SNP"), F.col("o_orderstatus").alias("RA"), F.col("o_totalprice").cast("double").alias("P-value"))
    made = golden.withColumn("RA", F.when((F.col("table_name") == "3") & (F.col("SNP") > "rs5"), "?").otherwise(F.col("RA"))).withColumn("P-value", F.when((F.col("table_name") == "4") & (F.col("SNP") > "rs3"), None).otherwise(F.col("P-value")))
    return gold.column_faults(made, golden)


def sheet_of(spark, sf_dir):
    return faulty(spark, sf_dir).withColumnRenamed("o_orderkey", "row")


def review_cells(spark, sf_dir):
    notes = read(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("row_idx"), F.lit("TopSNP").alias("col"), F.lit("issue").alias("status"), F.lit("see").alias("comment"), F.when(F.col("o_orderkey") % 4 == 0, "v0").otherwise("v1").alias("fingerprint"))
    found = review.curated_cells(sheet_of(spark, sf_dir), notes, "row", F.lit("v1"))
    return found.groupBy("col", "status", "comment").agg(F.count("*").alias("n"))


def review_rows(spark, sf_dir):
    notes = spark.createDataFrame([], "row_idx bigint, col string, status string, comment string, fingerprint string")
    return review.row_statuses(review.curated_cells(sheet_of(spark, sf_dir), notes, "row", F.lit("v1"))).groupBy("row_status").agg(F.count("*").alias("n"))


def edited_sheet(spark, sf_dir):
    sheet = sheet_of(spark, sf_dir)
    edits = sheet.where("row % 8 < 2").select(F.col("row").alias("row_idx"), F.lit("Chr").alias("col"), F.when(F.col("row") % 8 == 0, F.col("Chr")).otherwise("").alias("value"))
    found, updated = review.edited(sheet, edits, "row")
    return found.where("value is null").groupBy("col").agg(F.count("*").alias("n_null")).join(F.broadcast(updated))


def annotated_sheet(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("row_idx"), F.lit("Chr").alias("col"), F.lit("review").alias("status"), F.lit("c").alias("comment"), F.when(F.col("o_orderkey") % 3 == 0, "v0").otherwise("v1").alias("fingerprint"))
    marks = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("row_idx"), F.lit("Chr").alias("col"), F.when(F.col("o_orderkey") % 4 == 0, " issue ").otherwise("").alias("status"))
    return review.annotated(old, marks, F.lit("v1")).groupBy("status", "comment").agg(F.count("*").alias("n"))


def fix_list(spark, sf_dir):
    found = align.fix_list(diagnose_unmatched(spark, sf_dir).withColumn("bp", F.lit(None).cast("double")), F.lit("f.csv"))
    return found.groupBy("type", "reason", "bp", "effect", "source_mismatch_file").agg(F.count("*").alias("n"))


def mismatch_counts(spark, sf_dir):
    rows = diagnose_unmatched(spark, sf_dir)
    total = align.outcome_counts(rows).select(F.lit("failed").alias("reason"), F.col("failed_rows").alias("count"))
    return align.mismatch_reasons(rows, "gold_unmatched").unionByName(total).unionByName(align.with_reason(rows.where("type = 'pred_unmatched'").limit(0)))


def pred_total(spark, sf_dir):
    return align.predicted_total(evaluated(spark, sf_dir)["summary"], ["s0", "none"])


def runs_of(spark, sf_dir):
    """A run for each order, of two sheets."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    sheet = lambda n: F.concat(F.lit("d/from_"), k, F.lit(f"_table{n}_v1.xlsx"))
    return o.select(k.cast("string").alias("pmid"), F.lit("").alias("pmcid"), F.lit("me").alias("owner_name"), F.array(sheet(1), sheet(2)).alias("generated_harmonized"), F.concat(F.lit("e"), F.col("o_orderkey")).alias("eval_report"), F.concat(F.lit("2020-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("created_at"))


def latest_runs(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    wanted = c.select(F.concat(F.lit("d/from_"), F.col("c_custkey"), F.lit("_table2_v1.xlsx")).alias("path"))
    return stores.run_of_sheet(runs_of(spark, sf_dir), wanted).select("path", "pmid", "eval_report")


def related_tables(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    paths = o.select(F.concat(F.lit("d/"), F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_custkey"))).otherwise(F.concat(F.lit("from_"), F.col("o_custkey"), F.lit("_table"), F.col("o_orderkey") % 3, F.lit("_v1.xlsx")))).alias("path"))
    return stores.related_sheets(paths).select("path", F.size("related").alias("n"), F.get("related", F.lit(0)).alias("first"))


def run_views(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    rows = runs.select(F.explode("generated_harmonized").alias("path")).distinct().withColumn("n", F.when(F.col("path").endswith("table1_v1.xlsx"), 5).otherwise(1).cast("bigint"))
    reasons = runs.where(F.col("pmid").cast("int") % 3 == 0).select("eval_report", F.explode(F.array(F.struct(F.lit("a").alias("reason"), F.lit(4).cast("bigint").alias("count")), F.struct(F.lit("b").alias("reason"), F.lit(3).cast("bigint").alias("count")))).alias("x")).select("eval_report", "x.*")
    summary = runs.select("eval_report", F.lit(0.5).alias("row_precision"), F.lit(0.25).alias("row_recall"), F.lit(0.125).alias("row_f1"))
    return stores.run_results(runs, rows, reasons, summary).select("eval_report", "table_count", "success_rows", "failed_rows", F.size("predicted_issue_summary").alias("n_reasons"))


def tracker_of_results(spark, sf_dir):
    runs = runs_of(spark, sf_dir).groupBy("pmid").agg(F.max("eval_report").alias("eval_report")).withColumns({"pmcid": F.lit(None).cast("string"), "owner_name": F.lit("me"), "table_count": F.lit(2).cast("bigint")})
    current = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("pmid"), F.lit("high").alias("priority"), F.lit("m").alias("message"), F.col("c_name").alias("paper_title"))
    made = stores.tracker_entries(runs, current, F.lit("in"), F.array(F.lit("l")), F.lit("e"))
    return made.select("pmid", "pmcid", "status", "priority", "message", "paper_title", "table_count")


def issue_files(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.lit("pmid_7_mismatch_"), F.when(F.col("c_custkey") == 9, "combined_inputs").otherwise(F.col("c_custkey").cast("string")), F.lit("_raw.csv"))
    return stores.issue_files(c.select(name.alias("file_name")), 7, "raw", ["1", "2"]).unionByName(stores.issue_files(c.where("c_custkey <> 9").select(name.alias("file_name")), 7, "raw", ["1", "2"]))


def table_listing(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    table = F.concat(F.lit("<table-wrap id='T"), F.col("n_nationkey"), F.lit("'><label>Table "), F.col("n_nationkey"), F.lit("</label><caption><p>"), F.col("n_name"), F.lit("</p></caption><table><tr><td>x</td></tr></table></table-wrap>"))
    pages = n.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", table.alias("t")))), lambda x: x["t"]), "").alias("html"))
    return html_tables.described(html_tables.html_cells(pages))


def article_table_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    key = F.concat(F.lit("PMC"), F.col("page_id"))
    html = F.concat(F.lit("<a href='/articles/"), key, F.lit("/table/T2/'>t</a> see table/T1 and https://pmc.ncbi.nlm.nih.gov/articles/"), key, F.lit("/table/T2 <a href=\"/x\">y</a>"))
    return html_tables.linked_tables(p.select("page_id", key.alias("pmcid"), html.alias("html"))).select("page_id", "link", "table_id", "table_index")


def table_types(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    first = F.when(k % 4 == 0, "Hazard").when(k % 4 == 1, "SNP OR P").when(k % 4 == 2, "β").otherwise("Age")
    return headers.table_type(n.select(k.alias("table_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), first.alias("value")))


def all_match_columns(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    columns = n.select(k.alias("table_id"), F.posexplode(F.array(F.lit("SNP"), F.when(k % 2 == 0, "Marker x").otherwise("OR"), F.lit("HR"), F.lit("β"), F.lit("N"))).alias("col_idx", "name"))
    hits = headers.all_matches(columns, rules.ROLE_PATTERNS["rs"]).select("table_id", "col_idx")
    return columns.join(hits.withColumn("hit", F.lit(True)), ["table_id", "col_idx"], "left").select("table_id", "col_idx", "name", F.coalesce("hit", F.lit(False)).alias("hit"), headers.effect_type("name").alias("kind"))


def sheet_rows(spark, sf_dir):
    """Sheets of suppliers, one file for each nation, whose columns stand in different orders."""
    s = read(spark, sf_dir, "supplier")
    odd = F.col("s_nationkey") % 2 == 1
    path = F.concat(F.lit("f"), F.col("s_nationkey"))
    heads = s.select("s_nationkey").distinct().select(path.alias("path"), F.lit(0).alias("row_idx"), F.posexplode(F.when(odd, F.array(F.lit("Chr"), F.lit("TopSNP"))).otherwise(F.array(F.lit("TopSNP"), F.lit("Other")))).alias("col_idx", "value"))
    rows = s.select(path.alias("path"), (F.col("s_suppkey") + 1).cast("int").alias("row_idx"), F.posexplode(F.when(odd, F.array(F.lit("X"), F.col("s_name"))).otherwise(F.array(F.col("s_name"), F.lit("o")))).alias("col_idx", "value"))
    return sheets.named_rows(heads.unionByName(rows).withColumn("table_no", F.lit(0)), ["TopSNP", "Chr"])


def publication_list(spark, sf_dir):
    p = publications(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pmid"), F.lit("2020").alias("year"), "title", F.col("types").alias("publication_types"), F.concat("mesh", F.array(F.lit("b"))).alias("mesh_terms"), F.lit(4).alias("score"), F.lit(True).alias("relevant"), F.lit("r").alias("reason"))
    return stores.publication_rows(p)


#: Layouts two to ten, as headers and a row's values; {k} is a supplier's key.
LAYOUT_TABLES = [
    (["IGAP SNP", "Gene", "OR", "P", "Exonic SNP", "OR.1", "P.1", "OR.2", "P.2"], ["rs{k}", "G1", "1.5", "0.5", "rs9{k}", "1.25", "0.4", "1.75", "0.3"]),
    (["APOE4 stratification", "SNP", "Studies combined", "Number of observations", "Model", "Hazard Ratio", "Hazard Ratio 95 % CI", "P-value"], ["all", "rs{k}", "A+B", "{k}", "1", "2.0", "1.5;2.5", "0.25"]),
    (["APOE4 stratification", "SNP (chr:pos)", "SNP (rs)", "N (CI)", "N (CU)", "Hazard ratio", "Hazard ratio 95% CI", "P-value", "Gene"], ["carriers", "2:{k}_A_G", "rs{k}", "10", "20", "1.5", "1.1;1.9", "0.5", "BIN1"]),
    (["Variant", "Chr.", "Position", "Gene SYMBOL", "EA", "OR", "P", "OR.1", "P.1"], ["rs{k}", "1", "{k}", "CR1", "A", "1.5", "0.5", "0.75", "0.25"]),
    (["Chromosome", "SNP", "Gene", "EA", "RA", "EAF"] + [x for i in range(4) for x in (f"β value {i}", f"P value {i}")] + ["β value x", "P value x"] * 3, ["1", "rs{k}", "CR1", "A", "G", "0.2"] + ["0.5", "0.25"] * 7),
    (["Gene–gene combination | Gene–gene combination", "Genes included in the combination", "OR(95% CI.) | OR(95% CI.)", "P-value | one", "P-value | two"], ["rs{k} x rs2", "A, B", "2.5 (1.1-3.1)", "0.5", "0.25"]),
    (["Chr | Chr", "Position | Position", "Variant | Variant", "A1/A2a (MAF) | A1/A2a (MAF)", "Nearest gene | Nearest gene", "Cognitive domain | Cognitive domain", "Cohortsb | Cohortsb", "Genetic effects | βG (SE)", "Genetic effects | Pjoint"], ["3", "{k}", "rs{k}", "A/G (0.198)", "CLU", "Memory", "ADNI", "0.125 (0.04)", "0.5"]),
    (["IGAP SNP", "Closest gene", "Gene", "Probe set ID", "eQTL association beta", "eQTL association P", "AD association"], ["rs{k}", "CR1", "CR1L", "{k}", "0.5", "0.25", "0.125"]),
    (["eQTL", "Gene", "EA", "RA", "eSNP association summary a", "eSNP association summary b", "eSNP association summary c"], ["rs{k}", "CLU", "A", "G", "0.5 (0.25)", "0.25 (-0.5)", "Cortex"]),
]


def layout_records(spark, sf_dir):
    """Suppliers in tables of layouts two to ten, one for each nation; those of the inline layout begin with a row of group names."""
    s = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 9).cast("int").alias("kind"), F.col("s_nationkey").cast("int").alias("table_id"), F.col("s_suppkey").cast("int").alias("row_idx"))
    fill = lambda values: F.array(*[F.replace(F.lit(v), F.lit("{k}"), F.col("row_idx").cast("string")) for v in values])
    pick = lambda of: F.element_at(F.array(*[of(h, v) for h, v in LAYOUT_TABLES]), F.col("kind") + 1)
    rows = s.select("table_id", "row_idx", F.posexplode(pick(lambda h, v: fill(v))).alias("col_idx", "value"))
    tables = s.select("table_id", "kind").distinct()
    groups = tables.where("kind = 3").select("table_id", F.lit(0).alias("row_idx"), F.posexplode(F.array(*[F.lit(x) for x in ("", "", "", "", "", "APOE*4+", "", "APOE*4-", "")])).alias("col_idx", "value"))
    columns = tables.select("table_id", F.posexplode(pick(lambda h, v: F.array(*[F.lit(x) for x in h]))).alias("col_idx", "name"))
    found = extract.records(rows.unionByName(groups), columns)
    return found.select("table_id", "row_idx", "layout", "sub_no", "top_snp", "grp", "effect", "p", "effect_type", "confidence", F.concat_ws("|", "chrom", "bp", "ra1", "ra2", "locus", "ci", "sample_size", "cohort", "notes", "p_note").alias("rest"))


def subgroup_records(spark, sf_dir):
    """Suppliers in tables with two subgroups, alleles and frequencies in one column (even nations) or in columns of their own."""
    s = read(spark, sf_dir, "supplier")
    even, k = F.col("s_nationkey") % 2 == 0, F.col("s_suppkey")
    values = F.array(F.concat(F.lit("rs"), k), F.when(even, "C/T (0.25)").otherwise("G/A"), F.lit("1.5 (1.1-1.9)"), F.lit("0.5"), F.when(k % 3 == 0, "").otherwise("1.25"), F.when(k % 3 == 0, "").otherwise("0.25"))
    rows = s.select(F.col("s_nationkey").alias("table_id"), (k + 1).alias("row_idx"), F.posexplode(values).alias("col_idx", "value"))
    columns = s.select("s_nationkey", even.alias("e")).distinct().select(F.col("s_nationkey").alias("table_id"), F.posexplode(F.array(F.lit("SNP"), F.when(F.col("e"), "A1/A2a (MAF)").otherwise("EA/OA"), *[F.lit(f"{g} group | {m}") for g in ("male", "female") for m in ("OR", "P")])).alias("col_idx", "name"))
    found = extract.records(rows, columns)
    return found.select("table_id", F.col("row_idx").cast("bigint").alias("row_idx"), "top_snp", "grp", "effect", "ci", "p", "effect_type", "ra1", "ra2", "maf")


def sheet_opened(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("n_comment", F.when(F.col("n_nationkey") % 2 == 0, F.lit("c")))
    return review.opened(n.select("n_nationkey", "n_name", "n_comment"), ["n_nationkey"], 7)


def filled_gaps(spark, sf_dir):
    """Cells of documents' languages and sources, gaps kept as they are."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("t"), "lang", "source")
    return cells.to_cells(d, "t", "doc_id", ["lang", "source"]).groupBy("col_idx", "value").agg(F.count("*").alias("n"))


def article_tables(spark, sf_dir):
    """The wanted table of each page, to which tables are added in five ways: found by id, by label, by a link nearby, by its place, or not told from the others."""
    p, k = read(spark, sf_dir, "pages"), F.col("page_id") % 5
    table = lambda x: f"<table><tr><td>{x}</td></tr></table>"
    tails = [
        table("a") + f'<div id="t2"><p>x</p>{table("b")}</div>',
        table("a") + "<table></table><p>Table 3. Of b</p>" + table("b") + table("c"),
        table("a") + '<section><p>see <a href="/articles/PMC1/table/Z9/">it</a></p></section>' + table("b"),
        table("a") + "<table></table>" + table("b"),
        table("a") + table("b"),
    ]
    ids = ["T2", "x-T3", "Z9", "T2", "T7"]
    tail, wanted = F.lit(tails[-1]), F.lit(ids[-1])
    for i in range(4):
        tail, wanted = F.when(k == i, tails[i]).otherwise(tail), F.when(k == i, ids[i]).otherwise(wanted)
    return elements.article_tables(p.select("page_id", F.concat("html", tail).alias("html")), p.select("page_id", wanted.alias("table_id")))


def supplier_headers(spark, sf_dir):
    """Eight headers a supplier, which differ by table."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    names = F.array(F.lit("SNP"), F.when(k % 2 == 0, "P value").otherwise("P joint"), F.when(k % 3 == 0, "meta P").otherwise("Nearest Gene"), F.lit("OR (95% CI)"), F.when(k % 5 == 0, "β G").otherwise("HR"), F.when(k % 7 == 0, "Chr:Position").otherwise("BP"), F.when(k % 4 == 0, "A1/A2").otherwise("EA/OA"), F.concat(F.lit("marker "), F.col("s_name")))
    return s.select(k.alias("table_id"), F.posexplode(names).alias("col_idx", "name"))


def rule_roles(spark, sf_dir):
    """Roles by the built-in rules as a table, and by one more rule: a role of its own for the first header with a digit."""
    more = spark.createDataFrame([("numbered", 1, "[0-9]", "^marker", "first")], headers.RULE)
    return headers.roles_by_rules(supplier_headers(spark, sf_dir), headers.role_rules(spark).unionByName(more))


def nation_workbooks(spark, sf_dir):
    """A workbook of clients and vendors for each nation and hundred thousand ids, written by executors into a new shared folder."""
    key = lambda c: F.concat_ws("-", F.coalesce(F.col("nation_id").cast("string"), F.lit("none")), F.coalesce(F.floor(F.col(c) / 100_000).cast("string"), F.lit("none")))
    clients, vendors = (read(spark, sf_dir, t).withColumn("place", key(c)) for t, c in (("clients", "client_id"), ("vendors", "vendor_id")))
    sheets_of = {"clients": (clients, ["client_id", "updated_at", "source"]), "vendors": (vendors, ["vendor_id"])}
    listed = workbooks.write_workbooks(sheets_of, "place", stores.new_folder(spark, "workbooks"))
    return listed.select("key", F.col("sheet"), "n_rows", lk.base_name("path").alias("file_name"))


def incremental_curation(spark, sf_dir):
    """Suppliers as source workbooks, two for each paper of two hundred, curated; then the odd papers get a third workbook, and only these are read. Rows of each paper by the number of records, and what the second update did."""
    s = read(spark, sf_dir, "supplier").where("s_suppkey is not null")
    k = F.col("s_suppkey")
    number = (F.lit(30_000_000) + F.floor(k / 200)).cast("string")
    body = s.select(F.concat_ws("_table", number, k % 3 + 1).alias("file"), F.concat(F.lit("rs"), k).alias("SNP"), (k % 22 + 1).cast("string").alias("Chr"), F.concat(F.lit("GENE"), k % 7).alias("Gene"), F.lit("1.5").alias("OR"), F.lit("0.01").alias("P value"))
    folder = stores.new_folder(spark, "incremental")
    late = F.col("file").endswith("_table3")
    odd = F.substring("file", 8, 1).isin("1", "3", "5", "7", "9")
    settings = api.Settings(f"{folder}/out")
    papers = s.select(number.alias("paper_id")).distinct().withColumn("text", F.lit("Methods. A logistic regression."))
    book = lambda df: workbooks.write_workbooks({"t": (df, ["SNP"])}, "file", f"{folder}/in")
    book(body.where(~late))
    incremental.update(spark, papers, [f"{folder}/in/*.xlsx"], settings)
    book(body.where(late & odd))
    out = incremental.update(spark, papers, [f"{folder}/in/*.xlsx"], settings)
    read_now = out["extracted"].groupBy(F.substring(lk.base_name("name"), 1, 8).alias("paper_id")).agg(F.count("*").alias("n_read"))
    counts = out["curated"].groupBy("paper_id").agg(F.count("*").alias("n_records"), F.min("TopSNP").alias("first_snp"))
    return counts.join(read_now, "paper_id", "left").select("paper_id", "n_records", "first_snp", F.coalesce("n_read", F.lit(0)).alias("n_read"))


QUERIES = (
    table_addresses, editor_values, source_numbers, header_levels, publication_ids, paper_findings, cohort_of_rows, validation_issues, gold_canonical, predicted_canonical, gold_papers, evaluation_summary, evaluation_fields, evaluation_sets, evaluation_view, golden_rows, golden_names, golden_columns,
    review_cells, review_rows, edited_sheet, annotated_sheet, fix_list, mismatch_counts, pred_total, latest_runs, related_tables, run_views, tracker_of_results, issue_files, table_listing, article_table_links, table_types, all_match_columns, sheet_rows, publication_list, layout_records, subgroup_records, sheet_opened, filled_gaps, article_tables, rule_roles, nation_workbooks, incremental_curation,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
