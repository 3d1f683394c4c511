"""Addresses, ids and names of articles, tables and sheets: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, col, once, safe_name, strip, text

# The site of article tables, and the patterns of table addresses, ids and sheet names, in order.
SITE = "https://pmc.ncbi.nlm.nih.gov"
LINK_NUMBERS = ("/table/T(\\d+)/?$", "/table/Tab(\\d+)/?$", "/table/[^/?#]*tbl[-_]?0*(\\d+)/?$", "/table/[^/?#]*table[-_]?0*(\\d+)/?$", "/table/[^/?#]*-T(\\d+)/?$", "[?&]table=T(\\d+)\\b", "[?&]table_id=T(\\d+)\\b")
ID_NUMBERS = ("^t0*(\\d+)$", "^tbl0*(\\d+)$", "^table0*(\\d+)$", "^tab0*(\\d+)$", "^.+-t0*(\\d+)$", "(\\d+)$")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_group(c: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """The first group of the first pattern that matches; NULL without one."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(c, flags + p, 1)) for p in patterns])


def link_table_number(link: ColumnLike, fallback: ColumnLike) -> Column:
    """The number in a table's address, else the fallback."""
    return F.coalesce(first_group(text(link), LINK_NUMBERS).try_cast("int"), col(fallback).cast("int"))


def id_table_number(table_id: ColumnLike) -> Column:
    """The number in a table's id; NULL without one."""
    return first_group(F.lower(strip(text(table_id))), ID_NUMBERS, "").try_cast("int")


def special_page_id(table_id: ColumnLike) -> Column:
    """Ids such as x-T1 or at1, whose pages hold no table of that id."""
    return F.coalesce(strip(text(table_id)).rlike("(?i)^(.+-T\\d+|[A-Za-z].*t\\d+)$"), F.lit(False))


def article_and_table(url: ColumnLike) -> Column:
    """struct(pmcid, table_id) of an address, from its path or, without a table there and without more than the article, from its query."""
    u = text(url)
    pmcid = blank_to_null(F.upper(F.regexp_extract(u, "(?i)/articles/(PMC\\d+)", 1)))
    return F.struct(pmcid.alias("pmcid"), blank_to_null(F.regexp_extract(u, "(?i)/articles/PMC\\d+/table/([^/?#]+)", 1)).alias("table_id"))


def article_page(url: ColumnLike, pmcid: ColumnLike) -> Column:
    """The address if it is the article's, else the article's canonical one."""
    own = F.lower(text(url)).rlike("/articles/[^/]+/?$") & (F.lower(F.regexp_extract(text(url), "/articles/([^/]+)/?$", 1)) == F.lower(text(pmcid)))
    return F.when(own, text(url)).otherwise(F.concat(F.lit(f"{SITE}/articles/"), text(pmcid), F.lit("/")))


def table_page(pmcid: ColumnLike, table_id: ColumnLike) -> Column:
    """The address of a table by its id; the article's without one."""
    tid = strip(F.coalesce(text(table_id), F.lit("")))
    return F.concat(F.lit(f"{SITE}/articles/"), text(pmcid), F.lit("/"), F.when(tid != "", F.concat(F.lit("table/"), tid, F.lit("/"))).otherwise(F.lit("")))


def table_link(href: ColumnLike, pmcid: ColumnLike) -> Column:
    """The absolute address of a link to a table of the article, with a slash at its end; NULL for other links."""
    h, p = strip(F.coalesce(text(href), F.lit(""))), text(pmcid)
    in_article = F.concat(F.lit("(?i)https?://pmc\\.ncbi\\.nlm\\.nih\\.gov/articles/"), p, F.lit("/table/[^/?#]+/?"))
    path = F.concat(F.lit("(?i)/articles/"), p, F.lit("/table/[^/?#]+/?"))
    whole = F.regexp_substr(h, in_article)
    tail = F.regexp_substr(h, path)
    rooted, relative = blank_to_null(F.regexp_extract(h, "(?i)^/table/[^/?#]+/?", 0)), blank_to_null(F.regexp_extract(h, "(?i)^table/[^/?#]+/?", 0))
    base = F.concat(F.lit(f"{SITE}/articles/"), p)
    full = F.coalesce(whole, F.concat(F.lit(SITE), tail), F.concat(base, rooted), F.concat(base, F.lit("/"), relative))
    return F.when(full.endswith("/"), full).otherwise(F.concat(full, F.lit("/")))


def link_numbers(links: Column) -> Column:
    """Map of table number to link; of links with one number the last wins."""
    numbered = F.transform(links, lambda x, i: F.struct(link_table_number(x, i + 1).alias("number"), x.alias("link")))
    return once(numbered, lambda n: F.map_from_entries(F.filter(n, lambda x, i: ~F.exists(F.slice(n, i + 2, F.size(n)), lambda y: y["number"] == x["number"]))))


def base_name(path: ColumnLike) -> Column:
    return F.regexp_extract(text(path), "([^/\\\\]*)$", 1)


def sheet_pmid(path: ColumnLike) -> Column:
    """The paper of a curated sheet, from_{pmid}_table{n}_v{m}.xlsx; blank for other names."""
    return F.regexp_extract(base_name(path), "from_(\\d+)_table\\d+_v\\d+\\.xlsx$", 1)


def sheet_table_number(path: ColumnLike) -> Column:
    """The table of a curated sheet by its name; 1 for other names."""
    return F.coalesce(F.regexp_extract(base_name(path), "_table(\\d+)_v\\d+\\.xlsx$", 1).try_cast("int"), F.lit(1))


def source_table_number(paper_id: ColumnLike, source: ColumnLike, ordinal: ColumnLike, tables: ColumnLike) -> Column:
    """The logical number of a source's table: of an only table the paper id's suffix, else the file name's number; else its ordinal. tables: tables of the source."""
    own = F.regexp_extract(text(paper_id), "(?i)table[\\s_-]?(\\d+)$", 1).try_cast("int")
    named = F.regexp_extract(base_name(source), "(?i)table[\\s_-]?(\\d+)", 1).try_cast("int")
    return F.coalesce(F.when(col(tables) == 1, F.coalesce(own, named)), col(ordinal).cast("int"))


def safe_tag(c: ColumnLike, fallback: str = "run") -> Column:
    s = safe_name(F.coalesce(text(c), F.lit("")))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def joined_levels(levels: Column) -> Column:
    """One header from the levels of a header with several: parts joined by " | ", blank and nan ones left out."""
    parts = F.filter(F.transform(levels, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: ~F.lower(x).isin("", "nan"))
    return F.array_join(parts, " | ")


def general_number(c: Column, digits: int = 6) -> Column:
    """A number with so many significant digits as C's %g writes it: no trailing zeros, an exponent below 1e-4 and from 1e{digits}."""
    e = F.format_string(f"%.{digits - 1}e", c)
    exponent = F.regexp_extract(e, "e([+-]\\d+)$", 1).cast("int")
    trimmed = lambda s: F.regexp_replace(F.regexp_replace(s, "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    power = F.concat(trimmed(F.regexp_extract(e, "^(-?[0-9.]+)e", 1)), F.lit("e"), F.regexp_extract(e, "e([+-]\\d+)$", 1))
    # rounded to the digits first, then written out in full
    plain = F.format_number(e.cast("double"), 0)
    for places in range(1, digits + 4):
        plain = F.when(digits - 1 - exponent == places, F.format_string(f"%.{places}f", e.cast("double"))).otherwise(plain)
    plain = F.regexp_replace(plain, ",", "")
    return F.when((exponent < -4) | (exponent >= digits), power).otherwise(F.when(F.contains(plain, F.lit(".")), trimmed(plain)).otherwise(plain))


def editor_value(field: str, value: ColumnLike) -> Column:
    """A cell as an editor shows it: p-values and effects with six significant digits, other text as it is, missing ones blank."""
    v = F.coalesce(text(value), F.lit(""))
    if field not in ("P-value", "EffectSize(altvsref)"):
        return v
    n = strip(v).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), general_number(n)).otherwise(v)
