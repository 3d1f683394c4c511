"""Workbooks (xlsx), delimited files and publication XML as cells or records; and the writer of the fixed sheet."""

from __future__ import annotations

import csv
import io
import os
import re
import sys
import xml.etree.ElementTree as ET
import zipfile
from functools import reduce
from itertools import chain
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgrid.functions.links import source_table_number
from litgrid.plans.rules import CURATED_COLUMNS
from litgrid.sources.html_tables import html_cells

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CELLS = "path string, table_no int, name string, row_idx int, col_idx int, value string"


def column_index(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(data: bytes) -> list[tuple[int, str, int, int, str]]:
    """(sheet number, sheet name, row, column, text) of all cells with a value."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        for k, title in enumerate(titles):
            part = f"xl/worksheets/sheet{k + 1}.xml"
            if part not in names:
                continue
            at = -1
            for row in ET.fromstring(z.read(part)).iter(f"{MAIN}row"):
                # rows and cells without an address follow the one before
                at = int(row.get("r")) - 1 if row.get("r") else at + 1
                place = -1
                for c in row.iter(f"{MAIN}c"):
                    place = column_index(c.get("r")) if c.get("r") else place + 1
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                    if kind == "s" and text:
                        text = shared[int(text)]
                    if text:
                        out.append((k, title, at, place, text))
    return out


NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def workbook_frame(names: list[str], main: str, rel: str) -> dict[str, str]:
    """The parts of an xlsx file but its sheets."""
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names))
    types = f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
    types += "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(len(names))) + "</Types>"
    return {
        "[Content_Types].xml": types,
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names))) + "</Relationships>",
    }


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, table_no, name, row_idx, col_idx, value) of workbooks; a file is read whole by one task. A file that is none is an error."""
    return read_files(spark, path, "strict").drop("error")


def read_files(spark: SparkSession, path: str | list[str], broken: str = "rows") -> DataFrame:
    """CELLS of workbooks, and error: a file that can't be read gives one row with its error and no cell. broken="strict": it fails the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(p, *cell, None) for cell in workbook_cells(data)]
                except Exception as e:  # whatever a damaged file makes the readers of archives and markup raise
                    if broken == "strict":
                        raise
                    rows.append((p, *[None] * 5, repr(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*[p.split()[0] for p in CELLS.split(", ")], "error"])

    return files.mapInArrow(run, CELLS + ", error string")


def read_delimited(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """Cells of delimited files without headers of their own (all text). Lines keep their place in the file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = [(p, 0, "", r, c, v) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r, line in enumerate(csv.reader(io.StringIO(text or ""), delimiter=separator)) for c, v in enumerate(line)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in CELLS.split(", ")])

    return files.mapInArrow(run, CELLS)


KINDS = {"workbook": (".xlsx", ".xlsm"), "comma": (".csv",), "tab": (".tsv", ".txt"), "page": (".html", ".htm", ".xml", ".nxml")}


def kind_of(source: str) -> str:
    found = next((k for k, ends in KINDS.items() if source.lower().endswith(ends)), None)
    if found is None:
        raise ValueError(f"no reader for {source}")
    return found


TABLE_COLUMNS = ("path", "table_no", "row_idx", "col_idx", "value")


def of_kind(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """TABLE_COLUMNS and error of sources of one kind, in one read."""
    if kind == "workbook":
        return read_files(spark, paths).select(*TABLE_COLUMNS, "error")
    if kind == "page":
        pages = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
        cells = html_cells(pages, "path").withColumnRenamed("page_id", "path")
    else:
        cells = read_delimited(spark, paths, "," if kind == "comma" else "\t")
    return cells.select(*TABLE_COLUMNS, F.lit(None).cast("string").alias("error"))


def readable_tables(spark: SparkSession, source: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, errors): TABLE_COLUMNS of the sources that can be read, and (source, error) of those that can't: no reader for the kind, nothing there, or a broken file among good ones.

    One read for each kind, however many sources there are; only where a source isn't there are those of its kind looked up one by one."""
    sources = [source] if isinstance(source, str) else source
    by_kind: dict[str, list[str]] = {}
    failed: list[tuple[str, str]] = []
    for s in sources:
        try:
            by_kind.setdefault(kind_of(s), []).append(s)
        except ValueError as e:
            failed.append((s, repr(e)))
    parts = []
    for kind, paths in by_kind.items():
        try:
            parts.append(of_kind(spark, kind, paths))
        except AnalysisException:
            there = []
            for p in paths:
                try:
                    of_kind(spark, kind, [p])
                    there.append(p)
                except AnalysisException as e:
                    failed.append((p, e.getCondition() or repr(e)))
            if there:
                parts.append(of_kind(spark, kind, there))
    none = spark.createDataFrame([], "path string, table_no int, row_idx int, col_idx int, value string, error string")
    every = reduce(DataFrame.unionByName, parts, none)
    errors = every.where("error is not null").select(F.col("path").alias("source"), "error")
    return every.where("error is null").select(*TABLE_COLUMNS), errors.unionByName(spark.createDataFrame(failed, "source string, error string"))


def tables_from(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(path, table_no, row_idx, col_idx, value): cells of sources (files or patterns): workbooks, comma- or tab-separated files, and pages with tables. A source that can't be read is an error."""
    sources = [source] if isinstance(source, str) else source
    by_kind: dict[str, list[str]] = {}
    for s in sources:
        by_kind.setdefault(kind_of(s), []).append(s)
    parts = [read_workbooks(spark, paths) if kind == "workbook" else of_kind(spark, kind, paths) for kind, paths in by_kind.items()]
    return reduce(DataFrame.unionByName, [p.select(*TABLE_COLUMNS) for p in parts])


def table_numbers(tables: DataFrame, paper_id: str = "paper_id") -> DataFrame:
    """Tables (path, table_no, paper_id), a row each, with logical_no, the number that a source's table goes by."""
    w = Window.partitionBy("path")
    return tables.withColumn("logical_no", source_table_number(paper_id, "path", F.row_number().over(w.orderBy("table_no")), F.count("*").over(w)))


def logical_numbers(cells: DataFrame, paper_id: str = "paper_id") -> DataFrame:
    """cells(path, table_no, paper_id, ...) with logical_no, the number a source's table goes by."""
    numbered = table_numbers(cells.select("path", "table_no", paper_id).distinct(), paper_id)
    return cells.join(numbered.select("path", "table_no", "logical_no"), ["path", "table_no"])


def named_rows(cells: DataFrame, names: list[str], key: str = "path", sheet: str | None = None) -> DataFrame:
    """(path, row_idx, names ...): cells of each file's first sheet, or of the one of that title, as rows by the names in its first line; names that a file lacks are NULL."""
    first = (cells.where("table_no = 0") if sheet is None else cells.where(F.col("name") == sheet)).select(key, "row_idx", "col_idx", "value")
    heads = first.where("row_idx = 0").select(key, "col_idx", F.col("value").alias("name")).where(F.col("name").isin(*names))
    body = first.where("row_idx > 0").join(heads, [key, "col_idx"])
    return body.groupBy(key, "row_idx").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold file (tab-separated, with names) as text columns."""
    return spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(path)


def read_predicted(spark: SparkSession, path: str) -> DataFrame:
    """Curated sheets (.xlsx or .csv; a pattern may name many) as text columns by name, with source_file."""
    low = path.lower()
    if not low.endswith((".xlsx", ".csv")):
        raise ValueError(f"no reader for {path}")
    cells = read_workbooks(spark, path) if low.endswith(".xlsx") else read_delimited(spark, path)
    named = named_rows(cells, CURATED_COLUMNS)
    # a file's simplified cohorts count before its cohorts, blank or not
    simple = "Cohort_simplified (no counts)"
    has = cells.where("table_no = 0 and row_idx = 0").groupBy("path").agg(F.max(F.col("value") == simple).alias("__simple"))
    cohort = F.when(F.col("__simple"), F.col(f"`{simple}`")).otherwise(F.col("Cohort"))
    return named.join(has, "path").withColumn(simple, cohort).withColumnRenamed("path", "source_file").drop("__simple")


# The columns of an evaluation report's sheets.
SUMMARY_COLUMNS = ["file", "status", "key_cols", "n_pred_rows", "n_gold_rows", "row_precision", "row_recall", "row_f1"]
ACCURACY_COLUMNS = ["metric_set", "fields", "precision", "recall", "f1"]


def read_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Evaluation reports (a pattern may name many): their sheets' titles, summary, field_accuracy, and counts by reason of both lists of unmatched rows."""
    cells = read_workbooks(spark, path)
    reasons = [named_rows(cells, ["reason"], sheet=s).groupBy("path", F.coalesce("reason", F.lit("unmatched")).alias("reason")).agg(F.count("*").alias("count")).withColumn("sheet", F.lit(s)) for s in ("missing_from_prediction", "extra_prediction")]
    return {"sheets": cells.select("path", "table_no", "name").distinct(), "summary": named_rows(cells, SUMMARY_COLUMNS, sheet="summary"), "field_accuracy": named_rows(cells, ACCURACY_COLUMNS, sheet="field_accuracy"), "reasons": reasons[0].unionByName(reasons[1])}


def column_letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


#: Rows that a sheet can hold, its header included.
SHEET_ROWS = 1_048_576


def write_workbook(path: str, sheets: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """An xlsx file of reports (DataFrame and order of each sheet). Rows are streamed partition by partition into the file, so the driver holds one partition at a time; a sheet
    of more rows than it can hold is a ValueError, and belongs into parquet or csv."""
    part = f"{path}.part"
    with open(part, "wb") as out:
        stream_workbook(out, {n: chain([df.columns], (df.orderBy(*order) if order else df).toLocalIterator()) for n, (df, order) in sheets.items()})
    os.replace(part, path)


def workbook(rows_by_sheet: dict[str, list[list]]) -> bytes:
    """A small xlsx file in memory."""
    out = io.BytesIO()
    stream_workbook(out, rows_by_sheet)
    return out.getvalue()


def stream_workbook(out, rows_by_sheet: dict) -> None:
    """Writes an xlsx file row by row. Numbers stay numbers; None is no cell."""
    main, rel = MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(r: int, c: int, v) -> str:
        at = f"{column_letters(c)}{r}"
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v in (float("inf"), float("-inf")):
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(NOT_XML.sub("", str(v)))}</t></is></c>'
        return f'<c r="{at}"><v>{v!r}</v></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name, data in workbook_frame(list(rows_by_sheet), main, rel).items():
            z.writestr(name, data)
        for k, rows in enumerate(rows_by_sheet.values()):
            with z.open(f"xl/worksheets/sheet{k + 1}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate(rows, 1):
                    if r > SHEET_ROWS:
                        raise ValueError("too many rows for a sheet; write parquet")
                    part.write((f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None and v == v) + "</row>").encode())
                part.write(b"</sheetData></worksheet>")


def write_sheet(df: DataFrame, path: str, order: list[str], sheet: str = "curated") -> None:
    """One xlsx file of one sheet."""
    write_workbook(path, {sheet: (df, order)})


PUBLICATION = "struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>,QualifierName:array<struct<_VALUE:string>>>>>>>"


def publications(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """(pmid, title, abstract, publication_types, mesh_terms, year) of PubmedArticle elements."""
    # inline markup would make mixed content; its text stays
    flat = F.regexp_replace(xml, "</?(i|b|sup|sub|u|italic|bold)>", "")
    # elements without attributes get one, so that all of a list have the same shape
    for tag in ("AbstractText", "PublicationType", "DescriptorName", "QualifierName"):
        flat = F.regexp_replace(flat, f"<{tag}>", f'<{tag} _x="">')
    a = articles.withColumn("__a", F.from_xml(flat, PUBLICATION))
    m, art = "__a.MedlineCitation", "__a.MedlineCitation.Article"
    values = lambda c: F.filter(F.transform(c, lambda x: F.trim(x["_VALUE"])), lambda x: x != "")
    part = lambda x: F.when(x["_Label"].isNotNull(), F.concat(x["_Label"], F.lit(": "), F.coalesce(x["_VALUE"], F.lit("")))).otherwise(x["_VALUE"])
    none = F.expr("cast(array() as array<string>)")

    def heading(x):
        qualifiers = F.coalesce(values(x["QualifierName"]), none)
        return F.concat_ws(" / ", F.trim(x["DescriptorName"]["_VALUE"]), F.when(F.size(qualifiers) > 0, F.array_join(qualifiers, "; ")))

    date = f"{art}.Journal.JournalIssue.PubDate"
    return a.select(
        F.coalesce(f"{m}.PMID", F.lit("")).alias("pmid"), F.coalesce(F.trim(f"{art}.ArticleTitle"), F.lit("")).alias("title"),
        F.coalesce(F.array_join(F.filter(F.transform(f"{art}.Abstract.AbstractText", part), lambda x: x != ""), "\n"), F.lit("")).alias("abstract"),
        F.coalesce(F.array_distinct(values(f"{art}.PublicationTypeList.PublicationType")), none).alias("publication_types"),
        F.coalesce(F.array_distinct(F.filter(F.transform(f"{m}.MeshHeadingList.MeshHeading", heading), lambda x: x != "")), none).alias("mesh_terms"),
        F.coalesce(F.substring(F.coalesce(F.when(F.col(f"{date}.Year") != "", F.col(f"{date}.Year")), F.col(f"{date}.MedlineDate")), 1, 4), F.lit("")).alias("year"),
    )
