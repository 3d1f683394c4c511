"""Review of curated sheets: editable cells with statuses and comments, edits and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.links import editor_value
from litgrid.operators import enrich

# The columns that an editor shows, and those whose missing values need review.
EDITABLE = ["RecordID", "TopSNP", "Chr", "BP(Position)", "P-value", "EffectSize(altvsref)", "Cohort_simplified (no counts)", "Sample size", "Imputation_simple2", "Population_map", "Analysis group", "Phenotype", "LocusName", "Comment"]
NEEDED = ("TopSNP", "P-value", "Population_map", "Analysis group", "Phenotype")
COUNTED_AS_MISSING = ["TopSNP", "Chr", "BP(Position)", "P-value", "EffectSize(altvsref)", "Cohort_simplified (no counts)", "Sample size", "Population_map", "Analysis group"]


def editable_columns(sheet: DataFrame) -> list[str]:
    """Editable columns that the sheet has; a Comment column is always one."""
    return [c for c in EDITABLE if c in sheet.columns or c == "Comment"]


def needs_review(field: str, value: Column) -> Column:
    """Missing values of the needed columns."""
    if field not in NEEDED:
        return F.lit(False)
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("", "nr", "nan", "none"), F.lit(True))


def fingerprint(name: Column, size: Column, changed: Column) -> Column:
    """What tells one version of a sheet from another."""
    return F.concat_ws("|", name, size.cast("string"), changed.cast("string"))


def shown_cells(sheet: DataFrame, row: str) -> DataFrame:
    """(row_idx, col, value, needs) of a sheet's editable cells, as an editor shows them. row: the column that numbers rows."""
    columns = editable_columns(sheet)
    raw = {c: F.col(f"`{c}`") if c in sheet.columns else F.lit("") for c in columns}
    items = F.array(*[F.struct(F.lit(c).alias("col"), editor_value(c, raw[c]).alias("value"), needs_review(c, raw[c]).alias("needs")) for c in columns])
    return sheet.select(F.col(row).cast("bigint").alias("row_idx"), F.explode(items).alias("x")).select("row_idx", "x.*")


def curated_cells(sheet: DataFrame, annotations: DataFrame, row: str, version: Column) -> DataFrame:
    """(row_idx, col, value, status, comment): an annotation of this version of the sheet goes before the default of a missing value."""
    notes = annotations.where(F.col("fingerprint") == version).select("row_idx", "col", F.col("status").alias("note_status"), F.col("comment").alias("note_comment"), F.lit(True).alias("noted"))
    joined = shown_cells(sheet, row).join(notes, ["row_idx", "col"], "left")
    default = lambda word: F.when(F.col("needs"), word).otherwise("")
    pick = lambda note, word: F.when(F.col("noted"), F.coalesce(note, default(word))).otherwise(default(word))
    return joined.select("row_idx", "col", "value", pick("note_status", "review").alias("status"), pick("note_comment", "missing value").alias("comment"))


def row_statuses(cells: DataFrame) -> DataFrame:
    """(row_idx, row_status): issue before review before checked."""
    return cells.groupBy("row_idx").agg(enrich.review_status(F.collect_set(F.trim("status"))).alias("row_status"))


def edited(sheet: DataFrame, edits: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """(cells with the edits, (updated_rows)): an edit that shows as the old value is none; a blank one makes the cell NULL. edits(row_idx, col, value)."""
    cells = shown_cells(sheet, row).select("row_idx", "col", "value")
    changed = edits.join(cells.withColumnRenamed("value", "old"), ["row_idx", "col"]).where(F.col("value") != F.col("old")).select("row_idx", "col", "value")
    return enrich.with_edits(cells, changed), changed.agg(F.count_distinct("row_idx").alias("updated_rows"))


def annotated(annotations: DataFrame, marks: DataFrame, version: Column) -> DataFrame:
    """(row_idx, col, status, comment, fingerprint) after marks(row_idx, col, status): a status sets a cell's annotation, a blank one takes it away; cells without a mark keep
    theirs if it is of this version."""
    given = marks.select("row_idx", "col", F.trim(F.coalesce("status", F.lit(""))).alias("status"), F.lit("").alias("comment"))
    kept = annotations.where(F.col("fingerprint") == version).join(given, ["row_idx", "col"], "left_anti").select("row_idx", "col", "status", "comment")
    return kept.unionByName(given.where("status != ''")).withColumn("fingerprint", version)


def preview(sheet: DataFrame, order: list[str], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the first rows with blanks for NULL, (row_count) of all)."""
    first = sheet.orderBy(*order).limit(limit)
    return first.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in first.columns]), sheet.agg(F.count("*").alias("row_count"))


def opened(sheet: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """A sheet with blanks for NULL, and with row_count, which counts the rows shown."""
    shown = sheet if limit is None else sheet.orderBy(*order).limit(limit)
    count = F.count("*").over(Window.partitionBy())
    return shown.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in shown.columns], count.alias("row_count"))
