"""The engine's services: discovery, extraction, curation, evaluation and ranking over whole corpora in one plan each."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import links as lk
from litgrid.functions import text as tx
from litgrid.operators import align, cells, context, enrich, extract, gold, literature, scoring
from litgrid.plans import rules
from litgrid.sources import html_tables, sheets, stores, workbooks

FINDINGS = ("imputation", "stage", "association", "model", "population", "sample_size")


@dataclass(frozen=True)
class Settings:
    """Where outputs go, and the evaluation's defaults."""

    output: str
    scope: str = "like"
    mode: str = "auto"
    ignored: tuple[str, ...] = ("bp", "ra1")
    least_score: int = 5

    def folder(self, name: str) -> str:
        """A folder of the output: curated, validation, evaluation, runs, tracker, annotations."""
        return stores.inside(name, self.output)

    def as_text(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items()}


def discover_tables(pages: DataFrame, least_score: int = 5) -> DataFrame:
    """Tables of pages(page_id, html[, pmcid]) with scores, whether they are selected and, where the article is known, their addresses."""
    found = html_tables.html_cells(pages).withColumn("table_id", F.concat_ws(":", "page_id", "table_no"))
    heads = found.select("table_id", "page_id", "table_no", "table_index", "html_id", "label", "caption").distinct()
    texts = scoring.table_texts(heads.select("table_id", "label", "caption"), found.select("table_id", "row_idx", "col_idx", "value"))
    scored = scoring.scored_tables(heads.join(texts, "table_id"), "text", least_score).drop("text")
    if "pmcid" not in pages.columns:
        return scored
    named = scored.join(pages.select("page_id", "pmcid"), "page_id")
    return named.withColumn("link", lk.table_page("pmcid", "html_id"))


def selected_links(pages: DataFrame, given: list[str] | None = None, discover: bool = True, least_score: int = 5) -> list[str]:
    """The given links; without any, those of the tables that score enough (in order of articles and tables); a ValueError if there are none."""
    if given or not discover:
        return list(given or [])
    found = discover_tables(pages, least_score).where("selected").orderBy("page_id", "table_index").select("link")
    links = [r[0] for r in found.collect()]  # links of the papers of one request
    if not links:
        raise ValueError("no table matches the gene and p-value rule")
    return links


def normalized(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, columns) of raw grids without headers: empty rows and columns dropped, the header row chosen, a second header level joined."""
    body, columns = cells.with_header(cells.drop_empty(raw))
    return cells.merge_subheader(body, columns)


def curate(papers: DataFrame, raw: DataFrame, hints: DataFrame | None = None, rule_table: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """Curated records of raw(table_id, row_idx, col_idx, value, paper_id[, logical_no, link]), with context from papers(paper_id, text).

    The fixed sheet's columns, with paper_id, table_id, row_idx, sub_no, confidence, needs_review, evidence and audit. Papers without any record get one shell row.
    hints(pmid, table_idx, field, value): metadata that fill what neither rows nor text tell. rule_table: which headers have which role (headers.role_rules, as changed).
    keep: how normalized cells and columns, extracted records and papers' contexts are kept for what follows; a function that writes and reads them keeps plans small."""
    raw = raw if "logical_no" in raw.columns else raw.withColumn("logical_no", F.coalesce(F.col("table_id").try_cast("int"), F.lit(1)))
    raw = raw if "link" in raw.columns else raw.withColumn("link", F.lit(""))
    owner = raw.select("table_id", "paper_id", "logical_no", "link").distinct()
    # kept, so that what follows is planned (and, for papers without records, run) without the extraction; cells and columns too, as every layout reads them
    body, columns = map(keep, normalized(raw.select("table_id", "row_idx", "col_idx", "value")))
    found = keep(extract.records(body, columns, rule_table)).join(owner, "table_id")
    about = keep(context.paper_context(papers, "paper_id", "text", hints).withColumnsRenamed({f: f"p_{f}" for f in FINDINGS}))
    found = found.withColumn("place", F.concat(F.lit("Table "), F.col("logical_no").cast("string"))).withColumn("said", F.concat_ws(" ", "grp", "place", "row_text"))
    found = context.record_cohorts(found, "said", "place", papers)
    shell = papers.select("paper_id").join(found.select("paper_id").distinct(), "paper_id", "left_anti")
    every = found.unionByName(shell, allowMissingColumns=True).join(about, "paper_id", "left")
    if hints is not None:
        of_table = hints.where("table_idx is not null and field = 'Cohort'").groupBy(F.col("pmid").alias("h_pmid"), F.col("table_idx").alias("h_table")).agg(F.max("value").alias("h_cohort"))
        of_paper = hints.where("table_idx is null and field = 'Cohort'").groupBy(F.col("pmid").alias("g_pmid")).agg(F.max("value").alias("g_cohort"))
        every = every.join(F.broadcast(of_table), (F.col("paper_id").cast("string") == F.col("h_pmid")) & (F.col("logical_no") == F.col("h_table")), "left").join(F.broadcast(of_paper), F.col("paper_id").cast("string") == F.col("g_pmid"), "left")
        every = every.withColumn("hinted_cohort", F.coalesce("h_cohort", "g_cohort", F.lit("")))
    else:
        every = every.withColumn("hinted_cohort", F.lit(""))
    sheet = sheet_columns()
    own = every.withColumns({"__shell": F.col("table_id").isNull(), "__confidence": confidence(), "__evidence": row_evidence()})
    made = own.select("paper_id", "table_id", "row_idx", "sub_no", "logical_no", *[F.when(F.col("__shell"), shell_value(c)).otherwise(sheet[c]).alias(c) for c in rules.CURATED_COLUMNS], F.col("__confidence").alias("confidence"), needs_review().alias("needs_review"), F.col("__evidence").alias("evidence"), *[f"p_{f}" for f in FINDINGS])
    numbered = enrich.record_ids(made, "paper_id", ["logical_no", "table_id", "row_idx", "sub_no"])
    return numbered.withColumn("audit", record_audit()).drop("logical_no", *[f"p_{f}" for f in FINDINGS])


def generic() -> Column:
    return F.col("layout") == len(extract.LAYOUTS)


def paper_value(field: str) -> Column:
    value = F.col(f"p_{field}.value")
    return F.coalesce(tx.imputation_codes(value) if field == "imputation" else value, F.lit("NR"))


def cohort_value() -> Column:
    """What a layout says; else the codes of the row's cohort column and of the context; else the metadata's; else NR."""
    hint = F.when(generic(), tx.cohort_codes("cohort")).otherwise("NR")
    parts = F.filter(F.split(F.concat_ws(";", hint, tx.cohort_codes("cohort_found.value")), ";"), lambda x: x != "NR")
    merged = F.array_join(F.array_distinct(parts), ";")
    existing = F.when(generic(), F.lit("")).otherwise(tx.cell("cohort"))
    return F.coalesce(*[F.when(c != "", c) for c in (existing, merged, F.col("hinted_cohort"))], F.lit("NR"))


def sheet_columns() -> dict[str, Column]:
    """The fixed sheet's columns of a record: what its row says goes before what its paper says."""
    from_row = {column: F.col(name) for name, column in extract.FIELDS.items()}
    or_paper = lambda c, field: F.when(tx.cell(c) != "", tx.cell(c)).otherwise(paper_value(field))
    panel, cohort = tx.imputation_codes("imputation"), cohort_value()
    stage = paper_value("stage")
    given = {
        "RecordID": F.lit(""), "PaperIDX": F.col("paper_id").cast("string"), "TableIDX": F.concat(F.lit("T"), F.lpad(F.col("logical_no").cast("string"), 5, "0")), "TopSNP": tx.sanitize_topsnp("top_snp"), "Chr": tx.integer_like("chrom"), "BP(Position)": tx.integer_like("bp"), "LocusName": tx.sanitize_locus("locus"),
        "Stage": stage, "Stage_original": stage, "Analyses type": paper_value("association"), "Model type": or_paper("model", "model"), "Meta/Joint": tx.meta_or_joint(stage), "Imputation_simple2": F.when(panel != "NR", panel).otherwise(paper_value("imputation")), "Population": or_paper("population", "population"), "Sample size": or_paper("sample_size", "sample_size"),
        "Cohort": cohort, "Cohort_simplified (no counts)": F.when(cohort != "NR", cohort).otherwise(""), "Pubmed PMID": F.col("paper_id").cast("string"), "PMCID": F.lit(""), "Table Ref in paper": F.col("place"), "Table links": F.col("link"), "P-value": F.coalesce("p_raw", F.lit("")), "EffectSize(altvsref)": F.coalesce("effect_raw", F.lit("")),
    }
    return {c: given.get(c, from_row.get(c, F.lit(""))) for c in rules.CURATED_COLUMNS}


def shell_value(column: str) -> Column:
    """A paper's shell row: NR but for what the paper says."""
    said = {"Stage": "stage", "Analyses type": "association", "Model type": "model", "Imputation_simple2": "imputation", "Population": "population", "Sample size": "sample_size"}
    own = {"PaperIDX": F.col("paper_id").cast("string"), "Pubmed PMID": F.col("paper_id").cast("string"), "PMCID": F.lit(""), "RecordID": F.lit("")}
    return own.get(column, paper_value(said[column]) if column in said else F.lit("NR"))


def confidence() -> Column:
    weakest = [F.coalesce(f"p_{f}.confidence", F.lit(0.25)) for f in FINDINGS]
    blended = enrich.blended_confidence(F.coalesce("confidence", F.lit(0.4)), weakest, F.coalesce("cohort_found.confidence", F.lit(0.25)))
    return F.when(F.col("table_id").isNull(), F.least(*weakest)).otherwise(blended)


def needs_review() -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f"p_{f}.needs_review", F.lit(True)) for f in FINDINGS], F.coalesce("cohort_found.needs_review", F.lit(True)) | ~generic() | (F.col("name") == ""))


def row_evidence() -> Column:
    row = F.when(generic(), F.concat(F.lit("Row text: "), F.substring("row_text", 1, 340))).otherwise(F.substring("row_text", 1, 400))
    ids = F.when(F.col("paper_id").isNotNull(), F.concat(F.lit("PMID inferred from source filename -> "), F.col("paper_id").cast("string"))).otherwise("")
    of = lambda f: F.col(f"p_{f}.evidence")
    said = enrich.evidence(row, {"Stage": of("stage"), "Model": of("model"), "Imputation": of("imputation"), "Population": of("population"), "Sample size": of("sample_size"), "Cohort": F.col("cohort_found.evidence"), "ID": ids})
    return F.when(F.col("table_id").isNull(), F.lit("No extractable association records from tables. Use audit json for details.")).otherwise(said)


def record_audit() -> Column:
    """Nine audited fields of a record."""
    row = {"Name": (F.col("Name"), 0.9, 0.2, "table row rsID extraction"), "P-value": (F.col("`P-value`"), 0.7, 0.3, "table row p-value parsing"), "EffectSize(altvsref)": (F.col("`EffectSize(altvsref)`"), 0.65, 0.3, "table row effect parsing")}
    paper = {n: (F.col(f"`{n}`"), F.col(f"p_{f}")) for n, f in {"Stage": "stage", "Model type": "model", "Imputation_simple2": "imputation", "Population": "population", "Sample size": "sample_size"}.items()}
    blank = F.col("Cohort").isin("", "NR")
    cohort = F.struct(F.lit("Cohort").alias("field"), F.col("Cohort").alias("value"), F.when(blank, 0.25).otherwise(0.8).cast("double").alias("confidence"), F.substring("evidence", 1, 260).alias("evidence"), F.lit("cohort keyword mapping").alias("rule"), blank.alias("needs_review"))
    return F.concat(enrich.field_audit(row, F.col("evidence"), paper), F.array(cohort))


def evaluate(curated: DataFrame, reference: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """summary, fields and sets of curated records (by the sheet's names) against a gold table (by its names). The records are read several times: give stored ones, as run does."""
    pred = align.scoped(gold.canonical_predicted(curated), settings.scope)
    return align.evaluate(pred, gold.canonical_gold(reference), settings.mode, settings.ignored)


def evaluate_files(spark: SparkSession, reference: str, inputs: list[str], pmid: int, settings: Settings) -> dict[str, DataFrame]:
    """The evaluation of curated files (patterns) of one paper against a gold file, with the report written as a workbook, as (summary, fields, sets, missing, extra)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sheets.read_predicted(spark, i) for i in inputs])
    display = gold.of_paper(sheets.read_gold(spark, reference), pmid)
    canonical = align.scoped(gold.canonical_predicted(rows), settings.scope)
    tag = lambda df: df.withColumn("paper", F.lit(pmid))
    pred, known = tag(canonical), tag(gold.canonical_gold(display))
    out = align.evaluate_sources(pred, known, settings.mode, settings.ignored)
    chosen = align.report_summary(out["summary"]).first()
    folder = settings.folder("evaluation")
    path = os.path.join(folder, f"pmid_{pmid}_eval_report_{settings.scope}.xlsx")
    os.makedirs(folder, exist_ok=True)
    shown = gold.predicted_for_report(pred.drop("paper"))
    if chosen is None or chosen["status"] != "evaluated":
        info = align.with_report_columns(align.diagnose(pred.drop("paper"), None, [], ""))
        sheets.write_workbook(path, {"predicted_all_tables": (shown, ["source_file", "snp"]), "extra_prediction": (info, [])})
        return out | {"extra": info}
    keys = chosen["key_cols"].split(",")
    order = lambda df, *by: df.withColumn("__nth", F.monotonically_increasing_id())
    diagnosis = align.diagnose(order(pred.where("snp is not null")), order(known.where("snp is not null").withColumn("source_file", F.lit(None).cast("string"))), keys, "__nth").drop("__nth", "paper")
    listed = align.with_report_columns(diagnosis)
    out |= {"missing": listed.where("type = 'gold_unmatched'"), "extra": listed.where("type = 'pred_unmatched'")}
    summary = out["summary"].select(F.col("source_file").alias("file"), "status", "key_cols", "n_pred_rows", "n_gold_rows", "row_precision", "row_recall", "row_f1")
    accuracy = out["sets"].where(F.col("source_file") == chosen["source_file"]).select("metric_set", "fields", "precision", "recall", "f1")
    sheets.write_workbook(path, {"gold": (gold.gold_for_report(display), []), "predicted_all_tables": (shown, ["source_file", "snp"]), "missing_from_prediction": (out["missing"], ["snp"]), "extra_prediction": (out["extra"], ["snp"]), "summary": (summary, ["file"]), "field_accuracy": (accuracy, ["metric_set"])})
    return out


def write_curated(curated: DataFrame, folder: str) -> DataFrame:
    """A workbook for each paper, written by executors: (key, path, sheet, n_rows, n_bytes). folder: one that all executors see."""
    return workbooks.write_workbooks({"curated": (curated.select("paper_id", *[f"`{c}`" for c in rules.CURATED_COLUMNS]), ["RecordID"])}, "paper_id", folder)


def rank(articles: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """articles(xml) ranked by relevance; the profile of seeds, if given, adds to the score."""
    found = sheets.publications(articles)
    mesh = types = None
    if seeds is not None:
        own = sheets.publications(seeds).withColumn("seen", F.monotonically_increasing_id())
        # a profile holds the terms of some dozens of seed papers
        terms = {c: literature.as_array(literature.profile(own, c, "seen")).first()[0] for c in ("mesh_terms", "publication_types")}
        mesh, types = (F.lit(terms[c]) if terms[c] else F.expr("cast(array() as array<string>)") for c in ("mesh_terms", "publication_types"))
    score, reason = literature.relevance(F.col("title"), F.col("abstract"), F.col("publication_types"), F.col("mesh_terms"), mesh, types)
    scored = found.withColumns({"score": score, "reason": reason})
    return literature.ranked(scored, "pmid")


def raw_tables(spark: SparkSession, sources: list[str]) -> DataFrame:
    """raw(table_id, row_idx, col_idx, value, paper_id, logical_no, link) of files named by their papers' ids; files and tables of files are told apart by path and number."""
    return of_papers(sheets.tables_from(spark, sources))


def of_papers(cells: DataFrame) -> DataFrame:
    """raw of cells(path, table_no, row_idx, col_idx, value). What follows from a path is worked out once for each table, not for each cell."""
    tables = cells.select("path", "table_no").distinct().withColumn("paper_id", F.coalesce(tx.leading_pmid("path"), F.lit("NR")))
    named = sheets.table_numbers(tables).select("path", "table_no", F.concat_ws("#", "path", F.col("table_no").cast("string")).alias("table_id"), "paper_id", "logical_no", lk.base_name("path").alias("link"))
    return cells.join(named, ["path", "table_no"]).select("table_id", "row_idx", "col_idx", "value", "paper_id", "logical_no", "link")


def run(spark: SparkSession, papers: DataFrame, sources: list[str], settings: Settings, reference: DataFrame | None = None, hints: DataFrame | None = None, owner: str = "") -> dict[str, DataFrame]:
    """Curation of many sources in one plan, validation, evaluation if there is a gold reference, and a run log. sources: files or patterns, named by their papers' ids.

    Sources that can't be read don't stop the run: source_errors(source, error) of the result lists them."""
    cells, errors = sheets.readable_tables(spark, sources)
    made = curate(papers, of_papers(cells), hints)
    folder = settings.folder("curated")
    made.write.mode("overwrite").parquet(folder)
    curated = spark.read.parquet(folder)
    checked = enrich.validated(curated, flagged=F.col("needs_review"), note=F.col("`P-value note`"), row_evidence=F.col("evidence"))
    rows = enrich.validation_rows(checked, "paper_id", ["RecordID"])
    stores.write_validation(enrich.validation_documents(rows), settings.folder("validation"))
    out = {"curated": curated, "source_errors": errors, "validation": checked, "validation_summary": enrich.validation_summary(checked)}
    if reference is not None:
        out |= evaluate(curated, reference, settings)
    logs = papers.select(F.col("paper_id").cast("string").alias("pmid"), F.lit("").alias("pmcid"), F.lit(owner).alias("owner_name"), F.lit("").alias("paper_input"), F.lit(sources).alias("table_links"), F.array(F.lit(folder)).alias("generated_tables"), F.array(F.lit(folder)).alias("generated_harmonized"), F.lit(settings.folder("evaluation")).alias("eval_report"))
    stores.append_run(logs, settings.folder("runs"))
    return out
