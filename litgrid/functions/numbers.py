"""Scalar number functions of heterogeneous result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, cell, collapse, once, strip, text

# The notations that published parsers take for a power of ten.
_POWER = "(?i)([0-9.]+)\\s*[x*]\\s*10\\s*\\^?\\s*([+-]?\\s*[0-9]+)"
_SIGNED = "^([+-]?[0-9]*\\.?[0-9]+)\\s*(?:x\\s*10\\s*\\^?|[eE])\\s*([+-]?[0-9]+)$"


#: What a cast takes of texts that end in a digit or point and have no x. Others are not cast at all: a cast that fails makes an exception for each row.
_CAST = "^[\\x00-\\x20]*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _plain(c: ColumnLike) -> Column:
    """Trimmed, with the signs of multiplication and minus unified."""
    return F.translate(strip(text(c)), "×−–", "x--")


def _power(mantissa: Column, exponent: Column) -> Column:
    return mantissa.try_cast("double") * F.pow(F.lit(10.0), F.regexp_replace(exponent, "\\s+", "").try_cast("int"))


def _whole(s: Column) -> Column:
    """A whole-text number; s is trimmed. Underscores may part digits, and inf and infinity are numbers; other words that a cast would take (1d, 0x1p3) are none."""
    end, low = F.substring(s, -1, 1), F.lower(s)
    digits = F.when(F.contains(s, F.lit("_")), F.when(s.rlike("^(?:[^_]|(?<=[0-9])_(?=[0-9]))*$"), F.replace(s, F.lit("_"), F.lit("")))).otherwise(s)
    endless = F.when(F.lower(end).isin("f", "y") & low.rlike("^[+-]?inf(inity)?$"), F.when(F.startswith(low, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(endless, F.when(((end >= "0") & (end <= "9") | (end == ".")) & ~F.contains(low, F.lit("x")) & digits.rlike(_CAST), digits.try_cast("double")))


def safe_float(c: ColumnLike) -> Column:
    """Numbers, and powers of ten anywhere in the text, which go first. The mantissa's sign is not part of the notation (a quirk kept)."""
    s = F.regexp_replace(_plain(c), "([+-])\\s+(?=[0-9])", "$1")
    return once(s, lambda s: once(F.regexp_extract(s, _POWER, 1), lambda m: F.when(m != "", _power(m, F.regexp_extract(s, _POWER, 2))).otherwise(_whole(s))))


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c)).try_cast("double")


def norm_num(c: ColumnLike) -> Column:
    """Whole-text numbers and anchored notation, sign kept, to 12 significant digits."""
    s = F.translate(_plain(c), "X", "x")
    value = once(s, lambda s: F.coalesce(_whole(s), once(F.regexp_extract(s, _SIGNED, 1), lambda m: F.when(m != "", _power(m, F.regexp_extract(s, _SIGNED, 2))))))
    return significant(value, 12)


def is_neg_log(header: ColumnLike) -> Column:
    n = F.lower(collapse(header))
    compact = F.regexp_replace(n, "\\s+", "")
    logged = compact.rlike("log10|log_\\{10\\}|log\\(10\\)|-log")
    return (logged & n.rlike("\\bp\\b")) | F.contains(n, F.lit("−log10(p)")) | F.contains(compact, F.lit("-log10(p)"))


def p_value(c: ColumnLike, header: ColumnLike | None = None) -> Column:
    p = safe_float(c)
    return p if header is None else F.when(is_neg_log(header), F.pow(F.lit(10.0), -p)).otherwise(p)


_NUMBER = "([-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)"


def effect_of(c: ColumnLike) -> Column:
    """The first number of a cell such as 1.26 (0.83-1.92)."""
    return F.regexp_extract(F.translate(cell(c), "−–", "--"), _NUMBER, 1).try_cast("double")


def interval_of(c: ColumnLike, kind: ColumnLike) -> Column:
    """The interval of ratio effects: the first parenthesis that holds - or a comma; else blank."""
    found = F.regexp_extract(F.translate(cell(c), "−–", "--"), "(\\([^)]*[-,][^)]*\\))", 1)
    return F.when(text(kind).isin("OR", "HR"), found).otherwise(F.lit(""))


def effect_for_match(effect: ColumnLike, kind: ColumnLike) -> Column:
    """Betas as ratios, to 6 significant digits; other effects as they are."""
    e = text(effect).try_cast("double")
    return F.when(F.contains(F.lower(text(kind)), F.lit("beta")), significant(F.exp(e), 6)).otherwise(e)


def p_of_pair(c: ColumnLike) -> Column:
    """p of "p (beta)"."""
    return safe_float(F.regexp_extract(cell(c), "^([^(]*)", 1))


def beta_of_pair(c: ColumnLike) -> Column:
    inside = F.regexp_extract(cell(c), "\\(([^)]*)\\)", 1)
    return F.when(inside != "", safe_float(inside))


def slash_parts(c: ColumnLike) -> Column:
    return F.filter(F.transform(F.split(cell(c), "[\\\\/|]"), strip), lambda x: x != "")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_second(c: ColumnLike) -> tuple[Column, Column]:
    """Two parts between slashes, or two blanks."""
    two = once(slash_parts(c), lambda p: F.when(F.size(p) >= 2, p))
    return _blank(F.get(two, F.lit(0))), _blank(F.get(two, F.lit(1)))


def minor_major(c: ColumnLike) -> tuple[Column, Column]:
    """(minor, major) of "major/minor"."""
    major, minor = first_second(c)
    return minor, major


_ALLELES = "([^/\\s()]+)/([^()\\s]+)\\s*\\(([^)]+)\\)"


def groups(s: Column, pattern: str, n: int) -> Column:
    """The groups of the first match as an array; NULL without one. The pattern's groups must not be empty."""
    whole = F.regexp_extract(s, pattern, 0)
    return once(whole, lambda w: F.when(w != "", F.array(*[F.regexp_extract(w, pattern, k) for k in range(1, n + 1)])))


def alleles_and_frequency(c: ColumnLike) -> tuple[Column, Column, Column]:
    """A, G, 0.198 of "A/G (0.198)"."""
    found = once(cell(c), lambda s: F.coalesce(F.transform(groups(s, _ALLELES, 3), strip), F.slice(slash_pair(s), 1, 2)))
    return tuple(_blank(F.get(found, F.lit(k))) for k in range(3))


def slash_pair(c: Column) -> Column:
    """The parts between slashes if there are two or more, else none."""
    return once(slash_parts(c), lambda p: F.when(F.size(p) >= 2, p).otherwise(F.expr("cast(array() as array<string>)")))


_LOCATION = "^\\s*([0-9XYMxy]+)\\s*:\\s*([0-9]+)(?:_[ACGTacgt]+_[ACGTacgt]+)?\\s*$"
_LOCATION_ALLELES = "^\\s*([0-9XYMxy]+)\\s*:\\s*([0-9]+)_([ACGTacgt]+)_([ACGTacgt]+)\\s*$"


def chromosome_position(chromosome: ColumnLike, position: ColumnLike) -> tuple[Column, Column]:
    """From two columns, or from one that holds 20:45269867 or 20:45_A_G."""
    c, p = cell(chromosome), cell(position)
    both = F.when(F.contains(c, F.lit(":")), c).when(F.contains(p, F.lit(":")), p)
    found = groups(both, _LOCATION, 2)
    return F.coalesce(F.get(found, F.lit(0)), c), F.coalesce(F.get(found, F.lit(1)), p)


def location_alleles(c: ColumnLike) -> tuple[Column, Column, Column, Column]:
    """chromosome, position, reported allele 1 (alternative) and 2 (reference) of chr:pos_REF_ALT; blanks otherwise."""
    found = groups(cell(c), _LOCATION_ALLELES, 4)
    part = lambda k: _blank(F.get(found, F.lit(k)))
    return part(0), part(1), F.upper(part(3)), F.upper(part(2))


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """precision, recall and F1; 0 / 0 is 0."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), zero)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), zero)
