"""Gold and predicted records by their column names: canonical columns, display order and golden tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions import numbers as num
from litgrid.functions import text as tx
from litgrid.operators import align

# The canonical columns, the columns of a gold file and of a curated sheet that fill them (the first one there counts), the order
# of columns in reports, and the golden papers.
NUMBER, SNP, CHROMOSOME, ALLELE, TOKENS, TEXT = "number", "snp", "chromosome", "allele", "tokens", "text"
CANONICAL = {
    "pmid": (NUMBER, ["Pubmed PMID"], ["Pubmed PMID"]),
    "snp": (SNP, ["Top SNP"], ["TopSNP"]),
    "chr": (CHROMOSOME, ["#dbSNP_hg38_chr"], ["Chr"]),
    "bp": (NUMBER, ["dbSNP_hg38_position"], ["BP(Position)"]),
    "ra1": (ALLELE, ["RA 1(Reported Allele 1)"], ["RA 1(Reported Allele 1)"]),
    "pvalue": (NUMBER, ["P-value"], ["P-value"]),
    "effect": (NUMBER, ["OR_nonref"], ["EffectSize(altvsref)"]),
    "cohort": (TOKENS, ["Cohort_simple3"], ["Cohort_simplified (no counts)", "Cohort"]),
    "population": (TOKENS, ["Population_map"], ["Population_map"]),
    "sample_size": (NUMBER, ["Sample size"], ["Sample size"]),
    "analysis_group": (TOKENS, ["Analysis group"], ["Analysis group"]),
    "locus_name": (TEXT, ["LocusName"], ["LocusName"]),
    "phenotype": (TOKENS, ["Phenotype"], ["Phenotype"]),
    "phenotype_derived": (TOKENS, ["Phenotype-derived"], ["Phenotype-derived"]),
}
EFFECT_TYPE = "Effect Size Type (OR or Beta)"
PREDICTED_ORDER = ["source_file", "pmid", "snp", "pvalue", "effect", "effect_match", "chr", "bp", "ra1", "cohort", "population", "sample_size", "analysis_group", "phenotype", "phenotype_derived", "locus_name"]
GOLD_ORDER = ["Pubmed PMID", "Top SNP", "P-value", "OR_nonref", "#dbSNP_hg38_chr", "dbSNP_hg38_position", "RA 1(Reported Allele 1)", "Cohort_simple3", "Population_map", "Sample size", "Analysis group", "Phenotype", "Phenotype-derived", "LocusName"]
GOLDEN_COLUMNS = {"Pubmed PMID": "Pubmed PMID", "Top SNP": "SNP", "RA 1(Reported Allele 1)": "RA", "P-value": "P-value", "OR_nonref": "Effect", "#dbSNP_hg38_chr": "Chr", "dbSNP_hg38_position": "Pos", "Cohort_simple3": "Cohort", "Population_map": "Population"}
GOLDEN_PAPERS = [
    (30448613, "PMC6331247"), (30979435, "PMC6783343"), (31055733, "PMC6544706"), (30617256, "PMC6836675"), (30820047, "PMC6463297"), (29458411, "PMC5819208"), (29777097, "PMC5959890"),
    (30651383, "PMC6369905"), (31497858, "PMC6736148"), (30930738, "PMC6425305"), (31426376, "PMC6723529"), (29967939, "PMC6280657"), (29107063, "PMC5920782"), (29274321, "PMC5938137"),
    (30413934, "PMC6358498"), (30805717, "PMC7193309"), (30636644, "PMC6330399"), (29752348, "PMC5976227"), (28560309, "PMC5440281"), (27899424, "PMC5237405"),
]
#: Words that a table reader takes for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
COMPARED_COLUMNS = ["RA", "Chr", "Pos", "Effect", "P-value", "Cohort", "Population"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(c: Column) -> Column:
    """A cell as text; missing words to NULL."""
    s = c.cast("string")
    return F.when(~s.isin(*MISSING), s)


def normal_form(kind: str, c: Column) -> Column:
    return {NUMBER: num.norm_num, SNP: tx.norm_snp, CHROMOSOME: tx.norm_chr, ALLELE: tx.allele, TOKENS: tx.token_set, TEXT: tx.to_str}[kind](c)


def canonical(df: DataFrame, side: int) -> DataFrame:
    """The canonical columns of a gold (1) or predicted (2) table; columns that it doesn't have are NULL. Other columns are dropped but source_file and paper."""
    out = []
    for name, (kind, *sides) in CANONICAL.items():
        found = next((c for c in sides[side - 1] if c in df.columns), None)
        value = normal_form(kind, present(quoted(found))) if found else F.lit(None).cast("double" if kind == NUMBER else "string")
        out.append(value.alias(name))
    kept = [c for c in ("paper", "source_file") if c in df.columns]
    effect = next((c for c in CANONICAL["effect"][side] if c in df.columns), None)
    match = normal_form(NUMBER, present(quoted(effect))) if effect else F.lit(None).cast("double")
    if side == 2 and EFFECT_TYPE in df.columns:
        match = F.when(F.contains(F.lower(F.coalesce(present(quoted(EFFECT_TYPE)), F.lit(""))), F.lit("beta")), num.significant(F.exp(match), 6)).otherwise(match)
    return df.select(*kept, *out, match.alias("effect_match"))


def canonical_gold(df: DataFrame) -> DataFrame:
    return canonical(df, 1)


def canonical_predicted(df: DataFrame) -> DataFrame:
    return canonical(df, 2)


def of_paper(df: DataFrame, pmid: int) -> DataFrame:
    return df.where(quoted("Pubmed PMID").try_cast("double") == float(pmid))


def papers(df: DataFrame) -> DataFrame:
    """(pmid): the distinct papers of a gold file, as text of a whole number."""
    return df.select(quoted("Pubmed PMID").try_cast("double").cast("bigint").cast("string").alias("pmid")).where("pmid is not null").distinct()


def in_order(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that are there first, then the rest."""
    return df.select(*[quoted(c) for c in preferred if c in df.columns], *[quoted(c) for c in df.columns if c not in preferred])


def predicted_for_report(df: DataFrame, source: str | None = None) -> DataFrame:
    return in_order(df if source is None else df.withColumn("source_file", F.lit(source)), PREDICTED_ORDER)


def gold_for_report(df: DataFrame) -> DataFrame:
    return in_order(df, GOLD_ORDER)


def golden_tables(df: DataFrame, papers_of: list[tuple[int, str]] | None = None) -> DataFrame:
    """The golden rows of all papers, with table_name ({pmid}_{pmcid}) and row (place by SNP): renamed, projected, and the first three characters of Chr dropped."""
    spark = df.sparkSession
    listed = spark.createDataFrame(papers_of or GOLDEN_PAPERS, "p bigint, pmcid string")
    shown = df.select(*[quoted(c).alias(n) for c, n in GOLDEN_COLUMNS.items()]).withColumn("Chr", F.substring("Chr", 4, 1_000))
    named = shown.join(F.broadcast(listed), quoted("Pubmed PMID").try_cast("double") == F.col("p")).withColumn("table_name", F.concat_ws("_", F.col("p").cast("string"), "pmcid"))
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy(F.col("SNP").asc_nulls_last(), "P-value", "Effect"))
    return named.withColumn("row", nth).drop("p", "pmcid")


def name_faults(names: DataFrame, listed: DataFrame, column: str = "file_name") -> DataFrame:
    """(file_name, fault) of produced files: no .csv or .xlsx, not named {pmid}_{pmcid}, or not in the golden set. listed(file_name)."""
    stem = F.regexp_replace(F.col(column), "\\.(csv|xlsx)$", "")
    kind = F.when(~F.col(column).rlike("\\.(csv|xlsx)$"), "not a .csv or .xlsx").when(~stem.rlike("^\\d+_PMC\\d+$"), "not named pmid_pmcid")
    known = listed.select(F.regexp_replace(column, "\\.(csv|xlsx)$", "").alias("stem"), F.lit(True).alias("known")).distinct()
    joined = names.select(F.col(column), kind.alias("kind"), stem.alias("stem")).join(known, "stem", "left")
    return joined.select(column, F.coalesce("kind", F.when(F.col("known").isNull(), "not in the golden set")).alias("fault")).where("fault is not null")


def column_faults(produced: DataFrame, golden: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(table_name, column, SNP): per table and column the first SNP of the golden table whose values are not equal as multisets (a missing value equals nothing), all columns in
    one pass. Both: table_name, SNP and the columns. A column that the produced table lacks is the caller's to report."""
    columns = [c for c in columns or COMPARED_COLUMNS if c in produced.columns and c in golden.columns]
    keys = ["table_name", "SNP"]
    bags = align.field_bags(produced.select(*keys, *[quoted(c) for c in columns]), golden.select(*keys, *[quoted(c) for c in columns]), keys, columns)
    known = golden.select(*keys).distinct()
    missing = F.col("text").isNull() & F.col("num").isNull()
    wrong = bags.where(missing | (F.col("n_pred") != F.col("tp")) | (F.col("n_gold") != F.col("tp"))).select(*keys, F.col("field").alias("column")).distinct()
    return wrong.join(known, keys, "left_semi").groupBy("table_name", "column").agg(F.min("SNP").alias("SNP"))
