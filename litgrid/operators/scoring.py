"""Relevance of tables: keyword scores and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions.text import collapse, for_match
from litgrid.plans import rules

REASONS = {"gene": "gene-like keyword", "p_value": "p-value-like keyword", "effect": "association-statistic keyword", "variant": "variant-like keyword"}
POINTS = {"gene": 3, "p_value": 3, "effect": 1, "variant": 1}


def flags(text: Column) -> dict[str, Column]:
    n = for_match(text)
    return {k: n.rlike("|".join(f"(?:{p})" for p in patterns)) for k, patterns in rules.TABLE_PATTERNS.items()}


def table_score(text: Column) -> tuple[Column, Column]:
    """(score, reasons) of a table's label, caption, headers and first rows."""
    f = flags(text)
    support = f["p_value"] & (f["variant"] | f["effect"])
    parts = [*[(f[k], POINTS[k], REASONS[k]) for k in REASONS], (f["gene_count"], -4, "gene-count summary table"), (f["gene"] & f["p_value"], 2, "gene+p-value rule matched"), (support, 1, "association-table support")]
    score = sum((F.when(flag, points).otherwise(0) for flag, points, _ in parts), F.lit(0))
    return score, F.filter(F.array(*[F.when(flag, F.lit(why)) for flag, _, why in parts]), lambda x: x.isNotNull())


def scored_tables(tables: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """tables with score, reasons, selected and a preview."""
    score, reasons = table_score(F.col(text))
    return tables.withColumns({"score": score, "reasons": reasons}).withColumns({"selected": F.col("score") >= least, "preview": F.substring(collapse(text), 1, 400)})


def table_texts(tables: DataFrame, cells: DataFrame, first_rows: int = 15, most_values: int = 180) -> DataFrame:
    """(table_id, text): label, caption and the first values, in order. tables: table_id, label, caption."""
    top = cells.where(F.col("row_idx") < first_rows).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx", F.coalesce("value", F.lit("")).alias("v")))).alias("vs"))
    body = F.array_join(F.slice(F.transform("vs", lambda x: x["v"]), 1, most_values), " ")
    return tables.join(top, "table_id", "left").select("table_id", collapse(F.concat_ws(" ", "label", "caption", body)).alias("text"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with links: ordered distinct targets of anchors."""
    return pages.withColumn("links", F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<a\\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))))
