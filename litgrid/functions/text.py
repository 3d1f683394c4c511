"""Scalar text and identifier functions: Column in, Column out, all in code generation.

Three states of a cell are kept apart: NULL, the empty text, and the marker "NR".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litgrid.plans import rules

ColumnLike = Column | str

#: Python's \s also takes no-break spaces; Java's does with (?U).
SPACES = "(?U)\\s+"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnLike) -> Column:
    return col(c).cast("string")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used: plans stay small and patterns run once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: ColumnLike) -> Column:
    """White space runs to one space, ends trimmed; NULL to the empty text."""
    return strip(F.regexp_replace(F.coalesce(text(c), F.lit("")), SPACES, " "))


def normalize(c: ColumnLike) -> Column:
    return F.lower(collapse(c))


def for_match(c: ColumnLike) -> Column:
    """Normalised, with minus signs and dashes unified."""
    return F.translate(normalize(c), "−–", "--")


def cell(c: ColumnLike) -> Column:
    """Cell text: newlines to spaces, trimmed, missing words to the empty text."""
    s = strip(F.translate(F.coalesce(text(c), F.lit("")), "\n", " "))
    return once(s, lambda s: F.when(F.lower(s).isin(*rules.MISSING_CELLS), F.lit("")).otherwise(s))


def looks_missing(c: ColumnLike) -> Column:
    return F.lower(cell(c)).isin("", "-", "nr")


def is_missing_value(c: ColumnLike) -> Column:
    return F.upper(cell(c)).isin("", "NR")


def to_str(c: ColumnLike) -> Column:
    """Trimmed; blank to NULL."""
    return once(strip(text(c)), lambda s: F.when(s != "", s))


def norm_snp(c: ColumnLike) -> Column:
    """Lower case; a lone rs id loses trailing letters."""
    return F.regexp_replace(F.lower(to_str(c)), "^(rs\\d+)[a-z]+$", "$1")


def norm_chr(c: ColumnLike) -> Column:
    """19 from chr19 and 19.0."""
    s = F.regexp_replace(strip(F.replace(F.lower(to_str(c)), F.lit("chr"), F.lit(""))), "^(\\d+)\\.0+$", "$1")
    return once(s, lambda s: F.when(s != "", s))


def token_set(c: ColumnLike) -> Column:
    """Tokens between | , / ; as a sorted set joined by ;. None to NULL."""
    parts = F.transform(F.split(text(c), "[|,/;]"), lambda x: F.lower(strip(x)))
    return once(F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ";"), lambda s: F.when(s != "", s))


def allele(c: ColumnLike) -> Column:
    return F.upper(to_str(c))


def strip_footnote(c: ColumnLike) -> Column:
    """Drops one lower-case letter at the end of every token that has a character before it."""
    return strip(F.regexp_replace(text(c), "(?<=\\S)[a-z](?=\\s|$)", ""))


RS = "(?i)\\b(rs\\d+)[a-z]*\\b"


def first_rs(c: ColumnLike) -> Column:
    """The first rs id, lower case; NULL without one."""
    return once(F.lower(F.regexp_extract(text(c), RS, 1)), lambda s: F.when(s != "", s))


def rs_ids(c: ColumnLike) -> Column:
    """All rs ids as a sorted set of lower-case texts."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit("(?i)\\b(rs\\d+)\\b"), F.lit(1)), F.lower)))


def sanitize_topsnp(c: ColumnLike) -> Column:
    """Each /-separated part is its rs id or its text without a footnote letter; blank parts go."""
    part = lambda p: F.coalesce(first_rs(p), strip_footnote(strip(p)))
    return F.array_join(F.filter(F.transform(F.split(cell(c), "/"), part), lambda x: x != ""), "/")


def sanitize_locus(c: ColumnLike) -> Column:
    parts = F.transform(F.split(cell(c), ","), lambda p: strip_footnote(strip(p)))
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")


NUMERIC = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"


def number(c: ColumnLike) -> Column:
    """A whole-text number by one grammar for all engines, or NULL."""
    return once(strip(text(c)), lambda s: F.when(s.rlike(NUMERIC), s.try_cast("double")))


def integer_like(c: ColumnLike) -> Column:
    """Whole numbers without their fraction; other text as it is."""
    whole = lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e18), n.cast("decimal(38,0)").cast("string"))
    return once(cell(c), lambda s: F.coalesce(once(number(s), whole), s))


def tokens(c: ColumnLike) -> Column:
    """Ordered distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(normalize(c), "[^a-z0-9]+"), lambda x: x != ""))


def expand_abbreviations(c: ColumnLike) -> Column:
    out = text(c)
    for short, long in rules.ABBREVIATIONS.items():
        out = F.regexp_replace(out, f"(?i)\\b{short}\\b", long)
    return out


def vocabulary_codes(c: ColumnLike, synonyms: dict[str, str], codes: list[str] | None = None, missing: str = "NR") -> Column:
    """Per ;,/|-separated token the code of the first synonym it holds, else itself if it is a code; ordered, distinct, joined by ;."""
    def code(t):
        out = F.lit(None).cast("string")
        for word, value in reversed(list(synonyms.items())):
            out = F.when(F.contains(F.lower(t), F.lit(word)), F.lit(value)).otherwise(out)
        return F.coalesce(out, F.when(F.upper(t).isin(*codes), F.upper(t))) if codes else out

    parts = F.transform(F.filter(F.transform(F.split(text(c), "[;,/|]"), strip), lambda t: t != ""), code)
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), ";")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit(missing)).otherwise(joined)


def cohort_codes(c: ColumnLike) -> Column:
    return vocabulary_codes(c, rules.COHORT_SYNONYMS, rules.COHORTS)


def imputation_codes(c: ColumnLike) -> Column:
    """All panels named anywhere, in vocabulary order, then literal tokens."""
    low = F.lower(text(c))
    named = F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in rules.IMPUTATION_CODES.items()])
    values = sorted(set(rules.IMPUTATION_CODES.values()))
    literal = F.filter(F.transform(F.split(text(c), "[;,/|]"), strip), lambda t: t.isin(*values))
    joined = F.array_join(F.array_distinct(F.filter(F.concat(named, literal), lambda x: x.isNotNull())), ";")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("NR")).otherwise(joined)


def meta_or_joint(c: ColumnLike) -> Column:
    s = F.lower(strip(F.coalesce(text(c), F.lit(""))))
    return F.when(s.startswith("meta"), "Meta").when(s.startswith("joint"), "Joint").otherwise("NR")


def extracted(c: ColumnLike, pattern: str, group: int = 1) -> Column:
    s = F.regexp_extract(text(c), pattern, group)
    return F.when(s != "", s)


def article_id(c: ColumnLike) -> Column:
    """PMC id of an article address."""
    return F.upper(extracted(c, "(?i)/articles/(PMC\\d+)"))


def leading_pmid(c: ColumnLike) -> Column:
    """6 to 10 leading digits of a base name."""
    return extracted(F.regexp_extract(text(c), "([^/\\\\]*)$", 1), "^(\\d{6,10})(?:\\D|$)")


def pmid_of_sources(paper: ColumnLike, tables: ColumnLike) -> Column:
    """From the table sources first, then from the paper; NR without one."""
    many = F.filter(F.transform(sources(tables), leading_pmid), lambda x: x.isNotNull())
    return F.coalesce(F.get(many, F.lit(0)), leading_pmid(paper), F.lit("NR"))


def sources(c: ColumnLike) -> Column:
    """Comma-separated sources, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text(c), ","), strip), lambda x: x != "")


def links(c: ColumnLike) -> Column:
    """Sources between commas and newlines."""
    return F.filter(F.transform(F.split(text(c), "[,\n]"), strip), lambda x: x != "")


def flag(c: ColumnLike) -> Column:
    return F.lower(strip(text(c))).isin("1", "true", "yes", "on")


def pmcid(c: ColumnLike) -> Column:
    s = strip(F.coalesce(text(c), F.lit("")))
    return F.when(s.rlike("^\\d+$"), F.concat(F.lit("PMC"), s)).when(F.upper(s).startswith("PMC"), F.upper(s)).otherwise(s)


def article_url(c: ColumnLike, site: str) -> Column:
    p = pmcid(c)
    return F.when(p == "", F.lit("")).otherwise(F.concat(F.lit(site), p, F.lit("/")))


def is_url(c: ColumnLike) -> Column:
    return F.lower(text(c)).rlike("^https?://")


TABLE_NUMBER = ("(?i)^(?:t|tbl|tab|table)[-_]?0*(\\d+)$", "(?i)[-_.](?:t|tbl|tab|table)[-_]?0*(\\d+)$", "(?i)table[-_ ]?0*(\\d+)", "(?i)t0*(\\d+)$", "(\\d+)$")


def table_number(c: ColumnLike, fallback: Column | None = None) -> Column:
    """The number in a table's id or link; leading zeros dropped."""
    s = F.regexp_replace(strip(text(c)), "/+$", "")
    found = [F.regexp_extract(s, p, 1) for p in TABLE_NUMBER]
    number_text = F.coalesce(*[F.when(f != "", f) for f in found])
    return F.coalesce(number_text.try_cast("int"), fallback if fallback is not None else F.lit(None).cast("int"))


def safe_name(c: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def sheet_name(c: ColumnLike, fallback: str = "sheet") -> Column:
    s = F.substring(F.regexp_replace(collapse(c), "[\\\\/*?:\\[\\]]", "_"), 1, 31)
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def percent(c: ColumnLike) -> Column:
    n = number(c)
    return F.when(n.isNotNull(), F.format_string("%.1f%%", n * 100)).otherwise(F.lit("NA"))
