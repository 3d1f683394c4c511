"""HTML tables as cells. Row and column spans are allotted in reading order, which sets can't express, so pages are parsed in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.functions.links import article_and_table, id_table_number, table_link
from litgrid.functions.text import strip

SPACES = re.compile(r"\s+")
SCHEMA = "page_id bigint, table_no int, table_index int, html_id string, label string, caption string, row_idx int, col_idx int, value string"
#: Slots that one cell may span; a larger one ends with the last row there is, and spans at most WIDEST columns.
MOST_SLOTS, WIDEST = 10_000, 1000


def clean(text: str) -> str:
    return SPACES.sub(" ", text.replace("\xa0", " ")).strip()


class TableParser(HTMLParser):
    """Collects each table's id, label, caption and its rows of (text, row span, column span). Nested tables are tables of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: list[list] = []
        self.into: list[str] = []
        self.wrap = {"id": "", "label": "", "caption": ""}
        self.wraps = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "table-wrap":
            self.wrap = {"id": a.get("id", ""), "label": "", "caption": ""}
            self.wraps += 1
        elif tag == "table":
            table = {"id": self.wrap["id"] or a.get("id", ""), "label": self.wrap["label"], "caption": self.wrap["caption"], "rows": [], "index": self.wraps or len(self.tables) + 1}
            self.tables.append(table)
            self.open.append(table)
            self.wrap = {"id": "", "label": "", "caption": ""}
        elif tag in ("label", "caption"):
            self.into.append(tag)
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            cell = [[], span(a.get("rowspan")), span(a.get("colspan"))]
            self.open[-1]["rows"][-1].append(cell)
            self.cell.append(cell)
        elif self.cell:
            self.cell[-1][0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell:
            self.cell.pop()
        elif self.into and tag == self.into[-1]:
            self.into.pop()

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cell[-1][0].append(data)
        elif self.into:
            (self.open[-1] if self.open else self.wrap)[self.into[-1]] += data


def span(value: str | None) -> int:
    digits = re.match(r"\s*(\d{1,4})", value or "")
    return max(1, int(digits[1])) if digits else 1


def expanded(rows: list[list[list]]) -> list[list[str]]:
    """A full matrix: a cell fills the free slots of its spans; rows that only spans reach are kept; short rows are padded."""
    slots: dict[tuple[int, int], str] = {}
    height = len(rows)
    for r, cells in enumerate(rows):
        c = 0
        for text, down, across in cells:
            if down * across > MOST_SLOTS:
                down, across = min(down, len(rows) - r), min(across, WIDEST)
            while (r, c) in slots:
                c += 1
            for y in range(r, r + down):
                for x in range(c, c + across):
                    slots.setdefault((y, x), clean("".join(text)))
            height = max(height, r + down)
            c += across
    width = max((x for _, x in slots), default=-1) + 1
    return [[slots.get((y, x), "") for x in range(width)] for y in range(height)]


def tables_of(html: str) -> list[dict]:
    parser = TableParser()
    parser.feed(html or "")
    parser.close()
    return [t | {"grid": expanded(t["rows"])} for t in parser.tables]


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, table_no, table_index, html_id, label, caption, row_idx, col_idx, value) of all tables on the pages. Header rows are data; table_index counts
    wrappers (tables where there are none) from 1, those without a table too."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, t in enumerate(tables_of(text)):
                    for r, row in enumerate(t["grid"]):
                        out += [(page, n, t["index"], t["id"], clean(t["label"]), clean(t["caption"]), r, c, v) for c, v in enumerate(row)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [batch.schema.types[0], pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in SCHEMA.split(", ")])

    # pages are named by a number, or by a path
    named = dict(pages.dtypes)[key] == "string"
    slim = pages.select(F.col(key).cast("string" if named else "bigint"), F.col(html).cast("string"))
    return slim.mapInArrow(run, SCHEMA.replace("page_id bigint", "page_id string") if named else SCHEMA)


def pick_table(cells: DataFrame, wanted: str, index: int = 0) -> DataFrame:
    """Per page the table of this id; else of the same id in any case; else whose label or caption says the number; else the n-th."""
    number = re.search(r"(\d+)$", wanted or "")
    n = int(number[1]) if number else None
    rank = F.when(F.col("html_id") == wanted, 0).when(F.lower("html_id") == (wanted or "").lower(), 1)
    if n is not None:
        rank = rank.when(F.lower("label").isin(f"table {n}", f"t{n}") | F.lower("caption").startswith(f"table {n}"), 2).when(F.col("table_no") == n - 1, 3)
    else:
        rank = rank.when(F.col("table_no") == index, 3)
    best = cells.select("page_id", "table_no", rank.alias("rank")).where("rank is not null").groupBy("page_id").agg(F.min_by("table_no", F.struct("rank", "table_no")).alias("table_no"))
    return cells.join(best, ["page_id", "table_no"])


def described(cells: DataFrame, most: int = 20) -> DataFrame:
    """(page_id, text): a listing of a page's tables, for messages."""
    heads = cells.select("page_id", "table_no", "table_index", "html_id", "label", "caption").distinct()
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    line = F.concat(F.col("table_index").cast("string"), F.lit(": id="), dash(F.trim("html_id")), F.lit("; label="), dash(F.col("label")), F.lit("; caption="), F.substring(dash(F.col("caption")), 1, 120))
    per = heads.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("table_no", line.alias("line")))), 1, most).alias("x"))
    return per.select("page_id", F.array_join(F.transform("x", lambda x: x["line"]), " | ").alias("text"))


def table_links(pages: DataFrame, pmcid: str = "pmcid", html: str = "html") -> DataFrame:
    """pages with table_links: the distinct addresses of an article's tables, those of anchors first, then others in the page's source."""
    source, p = F.coalesce(F.col(html), F.lit("")), F.col(pmcid)
    # The forms of addresses.
    raw = [F.concat(F.lit("(?i)https?://pmc\\.ncbi\\.nlm\\.nih\\.gov/articles/"), p, F.lit("/table/[^\"'?#\\s>]+/?")), F.concat(F.lit("(?i)/articles/"), p, F.lit("/table/[^\"'?#\\s>]+/?")), F.lit("(?i)/table/[^\"'?#\\s>]+/?"), F.lit("(?i)table/[^\"'?#\\s>]+/?")]
    anchors = F.regexp_extract_all(source, F.lit("(?i)<a\\s[^>]*href\\s*=\\s*[\"']([^\"']+)"), F.lit(1))
    found = F.concat(anchors, *[F.regexp_extract_all(source, r, F.lit(0)) for r in raw])
    return pages.withColumn("table_links", F.array_distinct(F.filter(F.transform(found, lambda x: table_link(x, pmcid)), lambda x: x.isNotNull())))


def linked_tables(pages: DataFrame, pmcid: str = "pmcid") -> DataFrame:
    """(page columns, link, table_id, table_index) of table_links: the number in a table's id, else its place among the links."""
    each = table_links(pages, pmcid).select("*", F.posexplode("table_links").alias("__at", "link")).drop("table_links")
    table_id = article_and_table("link")["table_id"]
    return each.withColumn("table_id", F.coalesce(table_id, F.lit(""))).withColumn("table_index", F.coalesce(id_table_number("table_id"), F.col("__at") + 1)).drop("__at")


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text: markup, scripts and styles dropped, entities of the common kind decoded, blank lines collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?i)<(br|/p|/div|/li|/tr|/h[1-6])\\b[^>]*>", "\n"), "<[^>]+>", " ")
    for entity, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return pages.withColumn("text", strip(F.regexp_replace(F.regexp_replace(bare, "[ \\t\\x0B\\f\\r\\u00a0]+", " "), " ?\n[ \n]*", "\n")))
