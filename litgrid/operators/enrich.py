"""Records enriched with paper context, scored, numbered, audited and validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.numbers import safe_float
from litgrid.functions.text import cell, integer_like, is_missing_value, once, strip, text
from litgrid.operators.align import dealt_by_order
from litgrid.plans import rules


def first_present(*columns: Column) -> Column:
    """The first value that is neither blank nor NR; NR if there is none."""
    return F.coalesce(*[F.when(~is_missing_value(c), text(c)) for c in columns], F.lit("NR"))


def blended_confidence(row: Column, paper: list[Column], cohort: Column) -> Column:
    """0.4 of the row's, 0.4 of the weakest paper field's, 0.2 of the cohort's."""
    return 0.4 * row + 0.4 * F.least(*paper) + 0.2 * cohort


def evidence(row: Column, labelled: dict[str, Column], most: int = 240) -> Column:
    """The row's evidence and a line for each labelled snippet, cut; ends trimmed."""
    lines = [F.concat(F.lit(f"[{label} evidence] "), F.substring(F.coalesce(text(s), F.lit("")), 1, most)) for label, s in labelled.items()]
    return strip(F.concat_ws("\n", F.coalesce(text(row), F.lit("")), *lines))


def record_ids(records: DataFrame, paper: str, order: list[str]) -> DataFrame:
    """RecordID {paper}_R00001 ... in order within the paper."""
    nth = F.row_number().over(Window.partitionBy(paper).orderBy(*order))
    return records.withColumn("RecordID", F.concat(F.col(paper), F.lit("_R"), F.lpad(nth.cast("string"), 5, "0")))


def audit(fields: dict[str, tuple[Column, Column, str]]) -> Column:
    """Per field value, confidence, rule and whether it needs review (NR does; a blank counts as present)."""
    return F.array(*[F.struct(F.lit(n).alias("field"), text(v).alias("value"), c.cast("double").alias("confidence"), F.lit(rule).alias("rule"), (text(v) == "NR").alias("needs_review")) for n, (v, c, rule) in fields.items()])


def field_audit(row: dict[str, tuple[Column, float, float, str]], evidence_of: Column, paper: dict[str, tuple[Column, Column]]) -> Column:
    """The audit of a record. row: field to (value, confidence if it is there, if it is NR, rule), with the row's evidence; paper: field to (value, finding)."""
    item = lambda n, v, c, e, rule, review: F.struct(F.lit(n).alias("field"), text(v).alias("value"), c.cast("double").alias("confidence"), F.substring(F.coalesce(e, F.lit("")), 1, 260).alias("evidence"), rule.alias("rule"), review.alias("needs_review"))
    own = {n: item(n, v, F.when(text(v) != "NR", there).otherwise(missing), evidence_of, F.lit(rule), text(v) == "NR") for n, (v, there, missing, rule) in row.items()}
    return F.array(*own.values(), *[item(n, v, f["confidence"], f["evidence"], f["rule"], f["needs_review"]) for n, (v, f) in paper.items()])


def review_count(records: DataFrame, audits: str = "audit") -> DataFrame:
    return records.select(F.explode(audits).alias("a")).agg(F.count_if("a.needs_review").alias("n"))


OK, REVIEW, ISSUE = "ok", "review", "issue"


# The texts of issues.
NO_VALUE, NO_REQUIRED_VALUE = "missing value", "missing required value"
NO_RS_ID, NO_NUMBER_P, NO_PROBABILITY = "SNP does not look like an rsID", "p-value is not numeric", "p-value is outside 0-1"
NO_NUMBER_EFFECT, NO_CHROMOSOME, NO_POSITION, NO_ALLELE = "effect size is not numeric", "chromosome format is unusual", "position is not a positive number", "allele format is unusual"
MANY_P_VALUES = "multiple p-value columns may need a note"
SCHEMA_VERSION = "self_validation_v1"


def said(status: str, *issues: str) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.array(*[F.lit(i) for i in issues]) if issues else F.expr("cast(array() as array<string>)")).alias("issues"))


def without_value(field: str) -> Column:
    """What is said of a missing value."""
    return said(ISSUE, NO_REQUIRED_VALUE) if field in ("TopSNP", "P-value") else said(REVIEW, NO_VALUE)


def cell_check(field: str, value: Column) -> Column:
    """struct(status, issues) of one field's value by the field's rule. The cell's text, and its number where a rule asks for it, are computed once."""
    numeric = field in ("P-value", "EffectSize(altvsref)", "BP(Position)")

    def by_rule(x: Column) -> Column:
        v, n = x["v"], x["n"]
        rules_of = {
            "TopSNP": lambda: [(~v.rlike("(?i)\\brs\\d+\\b"), ISSUE, NO_RS_ID)],
            "P-value": lambda: [(n.isNull(), ISSUE, NO_NUMBER_P), ((n < 0) | (n > 1), ISSUE, NO_PROBABILITY)],
            "EffectSize(altvsref)": lambda: [(n.isNull(), REVIEW, NO_NUMBER_EFFECT)],
            "Chr": lambda: [(~strip(F.replace(F.lower(integer_like(v)), F.lit("chr"), F.lit(""))).rlike("^(?:[1-9]|1\\d|2[0-2]|x|y|mt|m)$"), REVIEW, NO_CHROMOSOME)],
            "BP(Position)": lambda: [(n.isNull() | (n <= 0), REVIEW, NO_POSITION)],
            "RA 1(Reported Allele 1)": lambda: [(F.exists(F.transform(F.split(v, "[/;,|]"), lambda a: F.upper(strip(a))), lambda a: ~a.isin("", *"ACGTID")), REVIEW, NO_ALLELE)],
        }
        out = said(OK)
        for bad, status, issue in reversed(rules_of.get(field, list)()):
            out = F.when(bad, said(status, issue)).otherwise(out)
        return F.when(F.upper(v).isin("", "NR"), without_value(field)).otherwise(out)

    n = safe_float(value) if numeric else F.lit(None).cast("double")
    return once(F.struct(cell(value).alias("v"), n.alias("n")), by_rule)


def validated(records: DataFrame, fields: dict[str, str] | None = None, flagged: Column | None = None, note: Column | None = None, row_evidence: Column | None = None) -> DataFrame:
    """records with checks (field to status and issues), row_issues and row_status. fields: rule name to column; all validated fields if not given, absent ones missing.

    note, row_evidence: a row whose evidence names numbered p-values needs a note on them."""
    fields = fields or {f: f for f in rules.VALIDATED_FIELDS}
    none = F.lit(None).cast("string")
    each = {f: cell_check(f, F.col(f"`{c}`")) if c in records.columns else without_value(f) for f, c in fields.items()}
    numbered = F.lit(False)
    if "P-value" in each and fields["P-value"] in records.columns:
        noted = cell(note if note is not None else none) != ""
        numbered = ~noted & cell(row_evidence if row_evidence is not None else none).rlike("(?i)p[- ]?value\\s*\\d+")
        also = lambda p: F.when(numbered, F.struct(F.when(p["status"] == OK, F.lit(REVIEW)).otherwise(p["status"]).alias("status"), F.concat(p["issues"], F.array(F.lit(MANY_P_VALUES))).alias("issues"))).otherwise(p)
        each["P-value"] = once(each["P-value"], also)
    out = records.withColumn("checks", F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*each.values())))
    # in the order of the fields, but what the note is about comes last
    own = F.flatten(F.transform(F.map_entries("checks"), lambda e: F.transform(F.filter(e["value"]["issues"], lambda i: i != MANY_P_VALUES), lambda i: F.concat(e["key"], F.lit(": "), i))))
    late = F.when(F.exists(F.map_values("checks"), lambda x: F.array_contains(x["issues"], MANY_P_VALUES)), F.array(F.lit(f"P-value: {MANY_P_VALUES}"))).otherwise(F.expr("cast(array() as array<string>)"))
    has = lambda s: F.exists(F.map_values("checks"), lambda x: x["status"] == s)
    status = F.when(has(ISSUE), "failed").when(has(REVIEW) | (flagged if flagged is not None else F.lit(False)), "warning").otherwise("success")
    return out.withColumns({"row_issues": F.concat(own, late), "row_status": status})


def numbered_by_paper(rows: DataFrame, paper: str, order: list[str], into: str) -> DataFrame:
    """rows with their number among the paper's, from 0. A number as the first order column deals a paper's rows into parts, whose numbers go on from the sizes of those before: they never meet in one task."""
    if dict(rows.dtypes)[order[0]] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return rows.withColumn(into, F.row_number().over(Window.partitionBy(paper).orderBy(*order)) - 1)
    # a missing number is in the first part, as it comes first
    dealt = dealt_by_order(rows, order[0]).withColumn("__part", F.coalesce("__part", F.lit(0)))
    sizes = dealt.groupBy(F.col(paper).alias("__paper"), F.col("__part").alias("__level")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__paper").orderBy("__level").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__paper", "__level", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = dealt.withColumn(into, F.row_number().over(Window.partitionBy(paper, "__part").orderBy(*order)) - 1)
    both = nth.join(starts, nth[paper].eqNullSafe(starts["__paper"]) & (nth["__part"] == starts["__level"]))
    return both.withColumn(into, (F.col(into) + F.col("__before")).cast("int")).drop("__part", "__paper", "__level", "__before")


def validation_rows(checked: DataFrame, paper: str, order: list[str], record_id: str = "RecordID", row_evidence: str = "evidence") -> DataFrame:
    """(paper, row_index, record_id, row_status, row_issues, fields) of validated records: fields with findings only, each with status, issues, value and evidence."""
    about = cell(row_evidence) if row_evidence in checked.columns else F.lit("")
    values = F.create_map(*[x for f in rules.VALIDATED_FIELDS for x in (F.lit(f), cell(f"`{f}`") if f in checked.columns else F.lit(""))])
    found = F.filter(F.map_entries("checks"), lambda e: e["value"]["status"] != OK)
    one = lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"]["status"].alias("status"), e["value"]["issues"].alias("issues"), F.coalesce(F.try_element_at(values, e["key"]), F.lit("")).alias("value"), F.substring(about, 1, 500).alias("evidence")).alias("value"))
    return numbered_by_paper(checked, paper, order, "__nth").select(F.col(paper).alias("paper"), F.col("__nth").alias("row_index"), (F.coalesce(F.col(record_id), F.lit("")) if record_id in checked.columns else F.lit("")).alias("record_id"), "row_status", "row_issues", F.map_from_entries(F.transform(found, one)).alias("fields"))


def validation_documents(rows: DataFrame) -> DataFrame:
    """(paper, document): the validation report of each paper as JSON, its rows in order."""
    item = F.struct("row_index", "record_id", "row_status", "row_issues", "fields")
    count = lambda s: F.count_if(F.col("row_status") == s).alias(s)
    per = rows.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("row_index", F.to_json(item).alias("j")))).alias("items"), count("success"), count("warning"), count("failed"))
    head = F.to_json(F.struct(F.col("paper").alias("paper_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct("success", "warning", "failed").alias("summary")))
    body = F.array_join(F.transform("items", lambda x: x["j"]), ",")
    return per.select("paper", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"rows":['), body, F.lit("]}")).alias("document"))


def validation_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("row_status").agg(F.count("*").alias("n"))


def missing_fields(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): fields with missing values, most first. Exactly the blank, NR, nan and None are missing here."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"`{f}`").isNull() | F.trim(F.col(f"`{f}`").cast("string")).isin("", "NR", "nan", "None")).alias("m")) for f in fields])
    return records.select(F.explode(items).alias("x")).groupBy("x.field").agg(F.count_if("x.m").alias("n")).where("n > 0").orderBy(F.desc("n"), "field")


def review_status(statuses: Column) -> Column:
    """issue before review before checked (all resolved)."""
    return F.when(F.array_contains(statuses, "issue"), "issue").when(F.array_contains(statuses, "review"), "review").when(F.array_contains(statuses, "resolved"), "checked").otherwise("")


def with_annotations(cells: DataFrame, annotations: DataFrame, fingerprint: Column) -> DataFrame:
    """cells(row_idx, col, value) with status and comment of the annotations made on this very version of the sheet."""
    current = annotations.where(F.col("fingerprint") == fingerprint).select("row_idx", "col", "status", "comment")
    return cells.join(current, ["row_idx", "col"], "left")


def with_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells with edited values, by row and column; a blank edit makes the value NULL."""
    new = edits.select("row_idx", "col", F.col("value").alias("__new"), F.lit(True).alias("__edited"))
    joined = cells.join(new, ["row_idx", "col"], "left")
    value = F.when(F.col("__edited"), F.when(F.trim("__new") != "", F.col("__new"))).otherwise(F.col("value"))
    return joined.select("row_idx", "col", value.alias("value"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest version of each key of both."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return current.unionByName(changes).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# Statuses to which entries may be moved.
MOVABLE = ("new", "in_progress", "complete")


def bulk_action(entries: DataFrame, keys: DataFrame, key: str, action: str, status: str = "", now: str | Column | None = None) -> DataFrame:
    """Entries with those of the keys deleted, or moved to one of the statuses there are, with updated_at the time of the move (now). Keys are trimmed texts; blank keys, other
    statuses and other actions leave all as it is."""
    if action not in ("delete", "move") or action == "move" and status not in MOVABLE:
        return entries
    chosen = keys.select(F.trim(F.col(key).cast("string")).alias("__key")).where("__key != ''").distinct()
    hit = F.trim(F.col(key).cast("string")) == F.col("__key")
    if action == "delete":
        return entries.join(chosen, hit, "left_anti")
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if now is None else F.lit(now) if isinstance(now, str) else now
    known = F.col("updated_at").cast("string") if "updated_at" in entries.columns else F.lit(None).cast("string")
    moved = entries.join(chosen, hit, "left").withColumns({"status": F.when(F.col("__key").isNotNull(), F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(F.col("__key").isNotNull(), at).otherwise(known)})
    return moved.drop("__key")
