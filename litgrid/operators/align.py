"""Alignment of predicted records with a gold standard, with bag semantics.

Both sides are tagged, unioned and grouped once, so a match is min(count, count) of one shuffle with partial aggregation; no join
is made. Missing text equals missing text; a missing number equals nothing, not even itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.numbers import precision_recall

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
# The keys, compared fields, field sets and report columns of published evaluations.
KEYS = ["pmid", "snp", "chr", "bp", "ra1", "pvalue"]
KEY_MODES = {"auto": KEYS, "pmid_snp_pvalue": ["pmid", "snp", "pvalue"], "pmid_snp_pvalue_effect": ["pmid", "snp", "pvalue", "effect_match"]}
COMPARED = ["pvalue", "effect", "cohort", "sample_size", "analysis_group", "population", "chr", "bp", "ra1"]
EASY = ["pvalue", "effect", "cohort", "sample_size", "analysis_group", "population", "chr"]
ALL = ["pmid", "snp", "chr", "bp", "pvalue", "effect", "cohort", "sample_size", "analysis_group", "population", "locus_name", "phenotype", "phenotype_derived", "ra1"]
UNMATCHED_COLUMNS = ["type", "reason", "source_file", "pmid", "snp", "pvalue", "effect", "effect_match", "chr", "bp", "ra1", "cohort", "population", "sample_size", "analysis_group", "phenotype", "phenotype_derived", "locus_name"]
COMBINED = "combined_inputs"


def is_number(df: DataFrame, name: str) -> bool:
    kind = dict(df.dtypes)[name]
    return kind in NUMERIC or kind.startswith("decimal")


def scoped(pred: DataFrame, scope: str = "raw", value: str = "pvalue", group: str = "analysis_group", derived: str = "phenotype_derived") -> DataFrame:
    """raw: all; like: identified rows with a value; primary: of these, no expression results."""
    if scope == "raw":
        return pred
    kept = pred.where(F.col("snp").isNotNull() & F.col(value).isNotNull())
    if scope == "like":
        return kept
    lacks = lambda c, word: ~F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word))
    return kept.where(lacks(group, "eqtl") & lacks(derived, "expression"))


def bag(pred: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per distinct key (within by): n_pred, n_gold, and tp, the matched number."""
    by = by or []
    side = lambda df, p, g: df.select(*by, *keys, F.lit(p).alias("__p"), F.lit(g).alias("__g"))
    both = side(pred, 1, 0).unionByName(side(gold, 0, 1))
    clean = [F.when(~F.isnan(k), F.col(k)).alias(k) if dict(both.dtypes)[k] in ("double", "float") else F.col(k) for k in keys]
    counts = both.select(*by, *clean, "__p", "__g").groupBy(*by, *keys).agg(F.sum("__p").cast("bigint").alias("n_pred"), F.sum("__g").cast("bigint").alias("n_gold"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys if is_number(pred, k)], F.lit(False))
    return counts.withColumn("tp", F.when(missing, F.lit(0)).otherwise(F.least("n_pred", "n_gold")).cast("bigint"))


def scores(bags: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per group."""
    total = bags.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("tp")).alias("fn"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def row_match(pred: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None, required: str | None = None) -> DataFrame:
    """Row-level scores. Rows without the required key are left out."""
    if required:
        pred, gold = pred.where(F.col(required).isNotNull()), gold.where(F.col(required).isNotNull())
    return scores(bag(pred, gold, keys, by), by or [])


def adaptive_keys(pred: DataFrame, gold: DataFrame, candidates: list[str], always: str = "snp") -> DataFrame:
    """One row (key, used): keys with a value on both sides; the identifier is always one. Lazy: one aggregation of each side."""
    any_value = lambda df: df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in candidates]).unpivot([], candidates, "key", "has")
    both = any_value(pred).unionByName(any_value(gold)).groupBy("key").agg(F.min(F.coalesce("has", F.lit(False))).alias("has"))
    return both.select("key", (F.col("has") | (F.col("key") == always)).alias("used"))


def chosen_keys(pred: DataFrame, gold: DataFrame, candidates: list[str] | None = None, ignored: tuple[str, ...] = ()) -> list[str]:
    """The adaptive choice as a list, identifier first."""
    candidates = [c for c in candidates or KEYS if c not in ignored and c in pred.columns and c in gold.columns]
    used = {r["key"] for r in adaptive_keys(pred, gold, candidates).where("used").collect()}
    return ["snp", *(c for c in candidates if c in used and c != "snp")]


def melted(df: DataFrame, keys: list[str], fields: list[str], numbers: set[str]) -> DataFrame:
    """(keys, field, text, num): a row per field; texts and numbers stay in columns of their own."""
    quote = lambda f: F.col(f"`{f}`")
    one = lambda f: F.struct(F.lit(f).alias("field"), (F.lit(None).cast("string") if f in numbers else quote(f).cast("string")).alias("text"), (quote(f).cast("double") if f in numbers else F.lit(None).cast("double")).alias("num"), F.lit(f in numbers).alias("is_num"))
    return df.select(*keys, F.explode(F.array(*[one(f) for f in fields])).alias("x")).select(*keys, "x.*")


def field_bags(pred: DataFrame, gold: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    numbers = {f for f in fields if is_number(pred, f)}
    number_keys = [k for k in keys if is_number(pred, k)]
    side = lambda df, p, g: melted(df, keys, fields, numbers).withColumns({"__p": F.lit(p), "__g": F.lit(g)})
    both = side(pred, 1, 0).unionByName(side(gold, 0, 1))
    counts = both.groupBy(*keys, "field", "text", "num", "is_num").agg(F.sum("__p").cast("bigint").alias("n_pred"), F.sum("__g").cast("bigint").alias("n_gold"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in number_keys], F.col("is_num") & F.col("num").isNull())
    return counts.withColumn("tp", F.when(missing, F.lit(0)).otherwise(F.least("n_pred", "n_gold")).cast("bigint"))


def field_match(pred: DataFrame, gold: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Scores per field; missing values count. A field that is missing throughout on either side is skipped."""
    return field_scores(field_bags(pred, gold, keys, fields), [])


def pooled_match(pred: DataFrame, gold: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Scores of all (key, field, value) together; missing values are left out."""
    bags = field_bags(pred, gold, keys, fields).where(F.coalesce(F.col("text"), F.col("num").cast("string")).isNotNull())
    return scores(bags, [])


#: Copies that one task writes, and parts into which the rows of a key are dealt by their order.
COPIES, DEALT = 10_000, 64


def bag_except(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left beyond their matches, as often as they are left over. A key's copies are made in portions, so that one key may have any number of them."""
    over = bag(left, right, keys).withColumn("n", F.col("n_pred") - F.col("tp")).where("n > 0")
    portions = over.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("__portion"))
    dealt = portions.repartition(*keys, "__portion")
    first = F.col("__portion") * COPIES + 1
    return dealt.select(*keys, F.explode(F.sequence(first.cast("int"), F.least(F.col("n"), first + COPIES - 1).cast("int"))).alias("copy"))


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """right with its columns of these names hidden, and the condition that they equal left's, null to null."""
    hidden = right.withColumnsRenamed({k: f"__right_{k}" for k in names})
    return hidden, reduce(lambda a, b: a & b, [left[k].eqNullSafe(hidden[f"__right_{k}"]) for k in names])


def dealt_by_order(rows: DataFrame, order: str) -> DataFrame:
    """rows with __part, which rises with the (numeric) order column: at its quantiles, DEALT numbers of one small job."""
    shares = [i / DEALT for i in range(1, DEALT)]
    bounds = rows.agg(F.percentile_approx(order, shares, 1_000)).first()[0] or []
    return rows.withColumn("__part", sum(((F.col(order) > b).cast("int") for b in sorted(set(bounds))), F.lit(0)))


def surplus(dealt: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __part, __spare) of the parts of dealt rows that outnumber their partners in right: in a part, rows numbered above __spare find none.

    A key's parts are numbered by their sizes and the sums of those before, so that its rows never have to meet. A missing number equals nothing."""
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = right.groupBy(*keys).agg(F.count("*").alias("__n"))
    levels = sizes.withColumn("__before", before)
    hidden, same = null_safe(levels, counts, keys)
    known = reduce(lambda a, b: a & b, [levels[k].isNotNull() for k in keys if is_number(dealt, k)], F.lit(True))
    spare = F.greatest(F.coalesce("__n", F.lit(0)) - F.col("__before"), F.lit(0))
    return levels.join(hidden, same & known, "left").withColumn("__spare", spare).where(F.col("__size") > F.col("__spare")).select(*keys, "__part", "__spare")


def picked(dealt: DataFrame, levels: DataFrame, keys: list[str], order: str, *more: str) -> DataFrame:
    """Rows numbered above their part's __spare, with more columns of levels."""
    nth = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    ranked = dealt.withColumn("__nth", nth)
    hidden, same = null_safe(ranked, levels, [*keys, "__part"])
    return ranked.join(hidden, same).where(F.col("__nth") > F.col("__spare")).select(*[ranked[c] for c in dealt.columns if c != "__part"], *more)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of left that find no partner when equal rows pair off in the order of a numeric column."""
    dealt = dealt_by_order(left, order)
    return picked(dealt, surplus(dealt, right, keys), keys, order)


def spelt(a: DataFrame, b: DataFrame, name: str) -> Column:
    """A value as text, alike on both sides if it is equal."""
    return F.col(name).cast("string") if dict(a.dtypes)[name] == dict(b.dtypes)[name] else F.col(name).cast("double").cast("string")


def reasons(lost: DataFrame, pred: DataFrame, gold: DataFrame, keys: list[str], identifier: str) -> DataFrame:
    """(keys, reason) of distinct keys without partner. Which values gold rows of an identifier have are marks (identifier, field, value), one of each: no identifier's values meet."""
    others = [k for k in keys if k != identifier]
    items = lambda: F.explode(F.array(F.struct(F.lit(-1).alias("f"), F.lit("").alias("v")), *[F.struct(F.lit(i).alias("f"), spelt(pred, gold, k).alias("v")) for i, k in enumerate(others)]))
    numbers = [i for i, k in enumerate(others) if is_number(pred, k)]
    marks = gold.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("__id"), items().alias("x")).select("__id", F.col("x.f").alias("__f"), F.col("x.v").alias("__v")).where(~(F.col("__f").isin(*numbers) & F.col("__v").isNull()) if numbers else F.lit(True)).distinct().withColumn("__hit", F.lit(True))
    asked = lost.select(*keys, items().alias("x")).select(*keys, F.col("x.f").alias("f"), F.col("x.v").alias("v"))
    found = asked.join(marks, (asked[identifier] == marks["__id"]) & (asked["f"] == marks["__f"]) & asked["v"].eqNullSafe(marks["__v"]), "left")
    missing = F.when(F.col("__hit").isNull(), F.col("f"))
    wide = found.groupBy(*keys).agg(F.array_sort(F.collect_list(missing)).alias("__missing"))  # a number per key column at most
    names = F.array(*[F.lit(f"{k}_mismatch") for k in others]) if others else F.array(F.lit(""))
    said = F.array_join(F.transform("__missing", lambda f: F.get(names, f)), "|")
    reason = F.when(F.array_contains("__missing", -1), F.lit(f"{identifier}_not_in_gold")).when(F.size("__missing") == 0, F.lit("key_mismatch")).otherwise(said)
    return wide.select(*keys, reason.alias("reason"))


def diagnose(pred: DataFrame, gold: DataFrame | None, keys: list[str], order: str, identifier: str = "snp") -> DataFrame:
    """Unmatched rows of both sides with a reason each.

    Predicted rows: snp_not_in_gold; else the keys whose value no gold row of the identifier has; else key_mismatch. Without a gold side (a paper that it doesn't hold): one row that says so.
    """
    if gold is None:
        return pred.sparkSession.range(1).select(F.lit("info").alias("type"), F.lit("pmid_not_in_gold").alias("reason"), *[F.lit(None).cast(kind).alias(c) for c, kind in pred.dtypes])
    dealt = dealt_by_order(pred, order)
    levels = surplus(dealt, gold, keys)
    why = reasons(levels.select(*keys).distinct(), pred, gold, keys, identifier)
    hidden, same = null_safe(levels, why, keys)
    explained = levels.join(hidden, same).select(*[levels[c] for c in levels.columns], "reason")
    extra = picked(dealt, explained, keys, order, "reason").select(F.lit("pred_unmatched").alias("type"), "reason", *pred.columns)
    lost = unmatched(gold, pred, keys, order).select(F.lit("gold_unmatched").alias("type"), F.lit("missing_in_prediction").alias("reason"), *[F.col(c) if c in gold.columns else F.lit(None).alias(c) for c in pred.columns])
    return extra.unionByName(lost)


def reason_counts(report: DataFrame, kind: str | None = None) -> DataFrame:
    rows = report if kind is None else report.where(F.col("type") == kind)
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def summary_rollup(tagged: DataFrame, source: str, measures: dict[str, Column]) -> DataFrame:
    """Sums per source and for all together (source "combined")."""
    rolled = tagged.rollup(source).agg(*[F.sum(c).alias(n) for n, c in measures.items()], F.grouping(source).alias("__all"))
    return rolled.select(F.when(F.col("__all") == 1, F.lit("combined")).otherwise(F.col(source)).alias("source"), *measures)


def with_report_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The report's columns first, absent ones NULL, then the rest."""
    columns = columns or UNMATCHED_COLUMNS
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], *[c for c in df.columns if c not in columns])


def preferred_first(df: DataFrame, preferred: list[str]) -> DataFrame:
    return df.select(*[c for c in preferred if c in df.columns], *[c for c in df.columns if c not in preferred])


def sets_equal(pred: DataFrame, gold: DataFrame, key: str, by: str) -> DataFrame:
    """Per group: do both sides have the same distinct keys; how many each lacks."""
    b = bag(pred.select(by, key).distinct(), gold.select(by, key).distinct(), [key], [by])
    lost, extra = F.sum(F.when(F.col("n_pred") == 0, 1).otherwise(0)), F.sum(F.when(F.col("n_gold") == 0, 1).otherwise(0))
    return b.groupBy(by).agg(lost.cast("bigint").alias("n_missing"), extra.cast("bigint").alias("n_extra")).withColumn("equal", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def counts_equal(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Per gold key: rows on both sides, and whether they agree."""
    b = bag(pred, gold, [key]).where("n_gold > 0")
    return b.select(key, "n_pred", "n_gold", (F.col("n_pred") == F.col("n_gold")).alias("equal"))


def multisets_equal(pred: DataFrame, gold: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key and column: are the values equal as multisets. A missing number fails."""
    return field_bags(pred, gold, [key], columns).groupBy(key, "field").agg((F.sum(F.abs(F.col("n_pred") - F.col("tp")) + F.abs(F.col("n_gold") - F.col("tp"))) == 0).alias("equal"))


#: Rows that one task joins with the facts of their groups.
PART_ROWS = 100_000


def with_combined(rows: DataFrame) -> DataFrame:
    """rows(paper, source_file, ...), and all once more under COMBINED with __again, which count for papers with several sources only."""
    return rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("__again")).withColumn("source_file", F.when(F.col("__again"), F.lit(COMBINED)).otherwise(F.col("source_file")))


def source_facts(pred: DataFrame, candidates: list[str]) -> DataFrame:
    """(paper, source_file, __several, __rows, n_pred_rows, use_{key} ...) of each source and, for papers with several, of all under COMBINED: rows are read once, what is known of a paper comes from that of its sources."""
    used = [f"use_{c}" for c in candidates]
    most = [F.max(c).alias(c) for c in used]
    totals = [F.sum(c).alias(c) for c in ("__rows", "n_pred_rows")]
    own = pred.where(F.col("paper").isNotNull()).groupBy("paper", "source_file").agg(F.count("*").alias("__rows"), F.count("snp").alias("n_pred_rows"), *[F.max(F.col(c).isNotNull()).alias(f"use_{c}") for c in candidates])
    # a paper has one row here for each of its sources at most
    several = own.groupBy("paper").agg((F.count("source_file") > 1).alias("__several"), *totals, *most)
    joint = several.where("__several").withColumn("source_file", F.lit(COMBINED))
    each = own.join(several.select("paper", "__several"), "paper").unionByName(joint)
    return each.groupBy("paper", "source_file", "__several").agg(*totals, *most)


def key_flags(facts: DataFrame, gold: DataFrame, candidates: list[str], adaptive: bool) -> DataFrame:
    """facts with known, use_{key} ... and key_cols: per source the keys to match by. adaptive: those with a value on both sides; the identifier always.
    known: is there any gold row for the paper; __gold: how many."""
    other = gold.groupBy("paper").agg(F.count("*").alias("__gold"), *[F.max(F.col(c).isNotNull()).alias(f"gold_{c}") for c in candidates]).withColumn("known", F.lit(True))
    joined = facts.join(other, "paper", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    use = {c: F.lit(True) if c == "snp" or not adaptive else F.coalesce(F.col(f"use_{c}") & F.col(f"gold_{c}"), F.lit(False)) for c in candidates}
    named = F.array(*[F.when(use[c] if c != "snp" or not adaptive else F.coalesce(F.col("use_snp") & F.col("gold_snp"), F.lit(False)), F.lit(c)) for c in candidates])
    names = F.filter(named, lambda x: x.isNotNull())
    names = F.when(F.array_contains(names, "snp"), names).otherwise(F.concat(F.array(F.lit("snp")), names))
    return joined.select("paper", "source_file", "__several", "__rows", "__gold", "n_pred_rows", "known", *[use[c].alias(f"use_{c}") for c in candidates], F.array_join(names, ",").alias("key_cols"))


def beside(rows: DataFrame, facts: DataFrame, by: list[str], made: int, groups: int) -> DataFrame:
    """rows joined with the facts of their group, some `made` rows of so many groups. Rows are dealt by a hash of their values too, and a group's facts come once for each deal: the rows of
    one group don't meet in one task, however many they are, and tasks get more with the rows, not larger."""
    parts = 1 + made // PART_ROWS
    deals = min(parts, max(DEALT, made // max(groups, 1)))
    tasks = max(parts, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(deals)).cast("int"))
    copies = facts.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    keys = [*by, "__deal"]
    # by sorting, as a broadcast would leave the rows in as few tasks as they were read by
    return dealt.repartition(tasks, *keys).hint("merge").join(copies.repartition(tasks, *keys), keys).drop("__deal")


def masked(joined: DataFrame, candidates: list[str]) -> DataFrame:
    """Rows beside their flags, with the keys as k_{key}; those that a source doesn't match by are one constant."""
    blank = {c: F.lit(0.0) if is_number(joined, c) else F.lit("") for c in candidates}
    return joined.withColumns({f"k_{c}": F.when(F.col(f"use_{c}"), F.col(c)).otherwise(blank[c]) for c in candidates})


def evaluate_sources(pred: DataFrame, gold: DataFrame, mode: str = "auto", ignored: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The evaluation of all sources of all papers in one plan. pred(paper, source_file, canonical columns), gold(paper, canonical columns).

    summary: a row per (paper, source_file) with status, key_cols, numbers of rows and row scores (NULL where the paper has no gold rows). fields: scores per compared field.
    sets: pooled scores of the two field sets. Papers with several sources have one more under COMBINED."""
    candidates = [c for c in KEY_MODES[mode] if (mode != "auto" or c not in ignored) and c in pred.columns and c in gold.columns]
    candidates = candidates if "snp" in candidates else ["snp", *candidates]
    # both sides are read several times, and what made them may be a long plan
    pred, gold = pred.persist(), gold.persist()
    by, keys = ["paper", "source_file"], [f"k_{c}" for c in candidates]
    compared = [f for f in COMPARED if f not in ignored and f in pred.columns and f in gold.columns]
    sets = {"easy_fields": EASY, "all_fields": [f for f in ALL if f not in ignored]}
    every = list(dict.fromkeys([*compared, *EASY, *sets["all_fields"]]))
    every = [f for f in every if f in pred.columns and f in gold.columns]
    flags = key_flags(source_facts(pred, candidates), gold, candidates, mode == "auto").persist()
    # two numbers of rows, of groups one: a small job over the flags
    size = flags.where("known").agg(F.sum("__rows"), F.sum("__gold"), F.count("*")).first()
    n_pred, n_gold, n_groups = (x or 0 for x in size)
    facts = flags.where("known").select(*by, "__several", *[f"use_{c}" for c in candidates])
    needed = list(dict.fromkeys([*candidates, *every]))
    read = lambda df, *more: df.where(F.col("snp").isNotNull()).select(*more, *needed)
    left = masked(beside(with_combined(read(pred, *by)), facts, by, n_pred, n_groups).where("not __again or __several"), candidates)
    # gold rows come once for each source of their paper
    right = masked(beside(read(gold, "paper"), facts, ["paper"], n_gold, n_groups), candidates)
    bags = bag(left, right, keys, by)
    # a gold row has a snp, but a side may have none at all
    rows = scores(bags, by).join(bags.groupBy(*by).agg(F.sum("n_gold").alias("n_gold_rows")), by)
    status = F.when(F.col("known"), "evaluated").otherwise("not_in_gold")
    summary = flags.select(*by, status.alias("status"), F.when(F.col("known"), F.col("key_cols")).otherwise("").alias("key_cols"), "n_pred_rows").where("paper is not null and source_file is not null").join(rows.drop("tp", "fp", "fn"), by, "left")
    nothing = F.when(F.col("status") == "evaluated", F.lit(0.0))
    summary = summary.select(*by, "status", "key_cols", "n_pred_rows", F.coalesce("n_gold_rows", F.lit(0)).alias("n_gold_rows"), *[F.coalesce(c, nothing).alias(f"row_{c}") for c in ("precision", "recall", "f1")])
    bags = field_bags(left.select(*by, *keys, *every), right.select(*by, *keys, *every), [*by, *keys], every)
    held = F.coalesce(F.col("text"), F.col("num").cast("string")).isNotNull()
    pooled = []
    for name, fields in sets.items():
        one = scores(bags.where(held & F.col("field").isin(fields)), by).withColumns({"metric_set": F.lit(name), "fields": F.lit(",".join(fields))})
        pooled.append(flags.where("known").select(*by, F.lit(name).alias("metric_set"), F.lit(",".join(fields)).alias("fields")).join(one.drop("metric_set", "fields"), by, "left"))
    both = pooled[0].unionByName(pooled[1]).select(*by, "metric_set", "fields", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    return {"summary": summary, "fields": field_scores(bags.where(F.col("field").isin(compared)), by), "sets": both}


def field_scores(bags: DataFrame, by: list[str]) -> DataFrame:
    """Scores per field; missing values count. A field that is missing throughout on either side is skipped."""
    held = F.coalesce(F.col("text"), F.col("num").cast("string")).isNotNull()
    per = bags.groupBy(*by, "field").agg(
        F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("tp")).alias("fn"),
        F.max(held & (F.col("n_pred") > 0)).alias("in_pred"), F.max(held & (F.col("n_gold") > 0)).alias("in_gold"),
    )
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return per.where("in_pred and in_gold").select(*by, "field", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def evaluate(pred: DataFrame, gold: DataFrame, mode: str = "auto", ignored: tuple[str, ...] = (), source: str = "input") -> dict[str, DataFrame]:
    """evaluate_sources of one table against one gold reference."""
    tag = lambda df: df.withColumn("paper", F.lit("paper"))
    pred = pred if "source_file" in pred.columns else pred.withColumn("source_file", F.lit(source))
    return {k: df.drop("paper") for k, df in evaluate_sources(tag(pred), tag(gold), mode, ignored).items()}


def report_summary(summary: DataFrame) -> DataFrame:
    """Per paper the combined row, else the first source's: what a reader of the report shows."""
    first = F.min_by(F.struct("source_file", "status", "key_cols", "n_pred_rows", "row_precision", "row_recall", "row_f1"), F.struct(F.col("source_file") != COMBINED, "source_file"))
    chosen = summary.groupBy("paper").agg(first.alias("x")).select("paper", "x.*")
    return chosen.withColumn("fields", F.split("key_cols", ",")).withColumnRenamed("n_pred_rows", "pred_total")


def with_reason(report: DataFrame) -> DataFrame:
    """Counts by reason, most first; rows without a reason count as unmatched."""
    return report.groupBy(F.coalesce("reason", F.lit("unmatched")).alias("reason")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "reason")


def mismatch_reasons(report: DataFrame, kind: str) -> DataFrame:
    """Counts of the reasons of one type, most first; blank reasons are left out."""
    rows = report.where((F.trim("type") == kind) & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    return rows.groupBy(F.trim("reason").alias("reason")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "reason")


def outcome_counts(report: DataFrame) -> DataFrame:
    """(success_rows, failed_rows): unmatched predictions fail; a report of mismatches alone knows of no success (a quirk kept)."""
    return report.agg(F.lit(0).cast("bigint").alias("success_rows"), F.count_if(F.col("type") == "pred_unmatched").alias("failed_rows"))


def predicted_total(summary: DataFrame, files: list[str]) -> DataFrame:
    """(pred_total): predicted rows of the sources with these base names."""
    name = F.regexp_extract("source_file", "([^/]*)$", 1)
    return summary.where(name.isin(*files)).agg(F.coalesce(F.sum("n_pred_rows"), F.lit(0)).alias("pred_total"))


def fix_list(report: DataFrame, source: Column | None = None) -> DataFrame:
    """Unmatched predictions as a list to mend, absent columns blank."""
    # The columns of the list.
    columns = ["type", "reason", "snp", "pmid", "chr", "bp", "ra1", "pvalue", "effect", "source_mismatch_file"]
    rows = report.where(F.col("type") == "pred_unmatched").withColumn("source_mismatch_file", source if source is not None else F.lit(""))
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
