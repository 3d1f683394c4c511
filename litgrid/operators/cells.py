"""Tables of any shape as one long dataset of cells (table_id, row_idx, col_idx, value) with columns (table_id, col_idx, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.text import cell, strip
from litgrid.plans import rules


def to_cells(df: DataFrame, table_id: str, row_idx: str, columns: list[str]) -> DataFrame:
    """Unpivots a wide frame; order of columns is their place in the list."""
    items = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(table_id).alias("table_id"), F.col(row_idx).alias("row_idx"), F.explode(items).alias("x")).select("table_id", "row_idx", "x.col_idx", "x.value")


def from_cells(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row per (table_id, row_idx) with a column per place; one aggregation."""
    return cells.groupBy("table_id", "row_idx").agg(*[F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])


def drop_empty(cells: DataFrame) -> DataFrame:
    """Blank cells to NULL; rows without a value go, then columns without one in the rows left."""
    value = cell("value")
    clean = cells.withColumn("value", F.when(value != "", value))
    by_row = Window.partitionBy("table_id", "row_idx")
    by_col = Window.partitionBy("table_id", "col_idx")
    rows = clean.withColumn("__r", F.max(F.col("value").isNotNull()).over(by_row)).where("__r").drop("__r")
    return rows.withColumn("__c", F.max(F.col("value").isNotNull()).over(by_col)).where("__c").drop("__c")


def distinct_names(columns: DataFrame, name: str = "name") -> DataFrame:
    """The k-th column of the same lower-case name in a table is called name_k."""
    nth = F.row_number().over(Window.partitionBy("table_id", F.lower(name)).orderBy("col_idx"))
    return columns.withColumn("__n", nth).withColumn(name, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("__n")))).drop("__n")


def header_row(cells: DataFrame, scanned: int = 5) -> DataFrame:
    """(table_id, header_idx): of the first rows the one with most header keywords; the first of equals."""
    top = cells.withColumn("__rank", F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_idx"))).where(F.col("__rank") <= scanned)
    per_row = top.groupBy("table_id", "row_idx").agg(F.sum(F.regexp_count(F.coalesce("value", F.lit("")), F.lit(rules.HEADER_KEYWORDS))).alias("hits"))
    return per_row.groupBy("table_id").agg(F.max_by("row_idx", F.struct(F.col("hits"), (-F.col("row_idx")).alias("first"))).alias("header_idx"))


def with_header(cells: DataFrame, scanned: int = 5) -> tuple[DataFrame, DataFrame]:
    """(body cells, columns) of tables whose own headers are generic: the chosen row names the columns."""
    chosen = header_row(cells, scanned)
    marked = cells.join(chosen, "table_id")
    name = F.coalesce("value", F.concat(F.lit("col_"), F.col("col_idx")))
    columns = distinct_names(marked.where("row_idx = header_idx").select("table_id", "col_idx", name.alias("name")))
    return marked.where("row_idx > header_idx").drop("header_idx"), columns


def subheader_row(cells: DataFrame, scanned: int = 3) -> DataFrame:
    """(table_id, sub_idx): the first of the first rows with enough metric keywords to be a second header level."""
    top = cells.withColumn("__rank", F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_idx"))).where(F.col("__rank") <= scanned)
    low = F.lower(F.coalesce("value", F.lit("")))
    hit = F.exists(F.array(*[F.lit(k) for k in rules.SUBHEADER_KEYWORDS]), lambda k: F.contains(low, k))
    per = top.groupBy("table_id", "row_idx").agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("width"))
    return per.where(F.col("hits") >= F.greatest(F.lit(3), F.floor(F.col("width") / 6))).groupBy("table_id").agg(F.min("row_idx").alias("sub_idx"))


def merge_subheader(cells: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers joined with their second level, rows through it dropped; tables without one stay as they are."""
    sub = subheader_row(cells)
    marked = cells.join(sub, "table_id", "left")
    second = marked.where("row_idx = sub_idx").select("table_id", "col_idx", F.col("value").alias("__sub"))
    merged = columns.join(second, ["table_id", "col_idx"], "left")
    name = F.when(F.coalesce("__sub", F.lit("")) != "", strip(F.concat("name", F.lit(" "), "__sub"))).otherwise(F.col("name"))
    body = marked.where(F.col("sub_idx").isNull() | (F.col("row_idx") > F.col("sub_idx"))).drop("sub_idx")
    return body, distinct_names(merged.select("table_id", "col_idx", name.alias("name")))


def section_rows(cells: DataFrame, marker: str) -> DataFrame:
    """(table_id, row_idx, label): rows with one distinct value, no rs id, and a marker word or a repeated long label."""
    value = cell("value")
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.count_distinct(F.when(value != "", F.lower(value))).alias("kinds"),
        F.sum((value != "").cast("int")).alias("filled"),
        F.count("*").alias("width"),
        F.max(F.when(value != "", value)).alias("label"),
        F.max(value.rlike("(?i)\\brs\\d+\\b")).alias("has_rs"),
    )
    like = F.lower("label").rlike(marker) | ((F.col("filled") / F.col("width") >= 0.6) & (F.length("label") >= 6))
    return rows.where((F.col("kinds") == 1) & ~F.col("has_rs") & like).select("table_id", "row_idx", "label")


def forward_fill(df: DataFrame, table: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's last value so far within its table."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
