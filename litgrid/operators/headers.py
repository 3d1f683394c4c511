"""Column roles from headers: aggregations over columns(table_id, col_idx, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgrid.functions.numbers import is_neg_log
from litgrid.functions.text import collapse, expand_abbreviations, normalize, strip
from litgrid.plans import rules


def holds(name: Column, patterns: list[str]) -> Column:
    """Any of the patterns as a substring."""
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(name, p))


def last_match(columns: DataFrame, patterns: list[str], fallback: list[str] | None = None) -> DataFrame:
    """(table_id, name): the right-most column that matches; the fallback only where nothing does."""
    n = normalize("name")
    pick = lambda p: F.max_by(F.when(holds(n, p), F.col("name")), F.when(holds(n, p), F.col("col_idx")))
    chosen = pick(patterns) if not fallback else F.coalesce(pick(patterns), pick(fallback))
    return columns.groupBy("table_id").agg(chosen.alias("name"))


def first_match(columns: DataFrame, patterns: list[str]) -> DataFrame:
    n = normalize("name")
    hit = holds(n, patterns)
    return columns.groupBy("table_id").agg(F.min_by(F.when(hit, F.col("name")), F.when(hit, F.col("col_idx"))).alias("name"))


def all_matches(columns: DataFrame, patterns: list[str]) -> DataFrame:
    return columns.where(holds(normalize("name"), patterns))


def p_value_tier(name: Column) -> Column:
    """Rank of a header as the p-value column, 1 is best; NULL: none."""
    n = normalize(name)
    inside = lambda w: F.contains(n, F.lit(w))
    return (
        F.when(inside("p meta") | inside("meta p"), 1)
        .when(inside("p joint"), 2)
        .when(inside("p value all") | inside("p-value all"), 3)
        .when(~inside("pf") & (n.isin("p", "p-value", "p value", "pval") | n.startswith("p_") | n.endswith("_p")), 4)
        .when(inside("p-value") | inside("p value"), 5)
        .when(is_neg_log(name), 6)
        .when(~inside("pf") & ~inside("het p") & n.rlike("\\bp\\b"), 7)
    )


def p_value_column(columns: DataFrame) -> DataFrame:
    """(table_id, name): the right-most column of the best tier."""
    tier = p_value_tier(F.col("name"))
    rank = F.when(tier.isNotNull(), F.struct((-tier).alias("tier"), F.col("col_idx")))
    return columns.groupBy("table_id").agg(F.max_by(F.when(tier.isNotNull(), F.col("name")), rank).alias("name"))


def effect_tier(name: Column) -> Column:
    n = normalize(name)
    inside = lambda w: F.contains(n, F.lit(w))
    main = (inside("beta") | inside("β")) & (inside(" g") | n.endswith("g")) & ~inside("x") & ~inside("×") & ~inside("interaction")
    return (
        F.when(main, 1)
        .when(n.rlike("\\bor\\b|odds ratio"), 2)
        .when(n.rlike("\\bbeta\\b|(?U)\\bβ\\b"), 3)
        .when(n.rlike("\\bhr\\b|hazard ratio"), 4)
        .when(n.rlike("\\bz[- ]?score\\b|\\bz\\b"), 5)
    )


def effect_column(columns: DataFrame) -> DataFrame:
    """(table_id, name, effect_type)."""
    tier = effect_tier(F.col("name"))
    rank = F.when(tier.isNotNull(), F.struct((-tier).alias("tier"), F.col("col_idx")))
    best = columns.groupBy("table_id").agg(F.max_by(F.when(tier.isNotNull(), F.struct("name", tier.alias("tier"))), rank).alias("x"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Beta", "OR", "Beta", "HR", "Zscore")]), F.col("x.tier"))
    return best.select("table_id", "x.name", F.coalesce(F.when(F.col("x").isNotNull(), kind), F.lit("NR")).alias("effect_type"))


def effect_type(name: Column) -> Column:
    n = normalize(name)
    return F.when(n.rlike("beta|β"), "Beta").when(n.rlike("\\bor\\b|odds ratio"), "OR").when(n.rlike("\\bhr\\b|hazard ratio"), "HR").when(n.rlike("\\bz[- ]?score\\b|\\bz\\b"), "Zscore").otherwise("NR")


def group_label(columns: DataFrame) -> DataFrame:
    """(table_id, label): the first header part with the word group, one that says more than that if there is one."""
    parts = columns.select("table_id", "col_idx", F.posexplode(F.split("name", "\\|")).alias("pos", "part")).withColumn("part", collapse("part"))
    named = parts.where(F.col("part").rlike("(?i)\\bgroup\\b"))
    generic = F.lower("part").isin("group", "analysis group")
    return named.groupBy("table_id").agg(F.min_by("part", F.struct(generic.alias("g"), "col_idx", "pos")).alias("label"))


METRICS = {
    "snp": "\\bsnp\\b|\\brsid\\b|\\bvariant\\b",
    "p": "\\bp[- ]?values?\\b|\\bp\\b|\\bpval\\b|\\bmeta p\\b",
    "ci": "95\\s*%?\\s*ci|\\bci\\b|confidence interval",
    "effect": "\\bor\\b|odds ratio|\\bbeta\\b|β|\\bhr\\b|hazard ratio|\\bz[- ]?score\\b|\\beffect\\b",
}


def subgroups(columns: DataFrame) -> DataFrame:
    """(table_id, label, metric, name): which column holds which metric of which subgroup.

    A label is the header part with the word group, else the last but one part, else the header without its metric. The first column
    per label and metric stays unless a later one says "p meta". Labels stay with two metrics including an effect or interval, or if they
    come from parts and have a statistic.
    """
    n = normalize("name")
    metric = F.lit(None).cast("string")
    for kind in reversed(METRICS):
        metric = F.when(n.rlike(METRICS[kind]), kind).otherwise(metric)
    metric = F.when(n.rlike("het p|\\bpf\\b"), F.lit(None)).otherwise(metric)
    parts = F.filter(F.transform(F.split("name", "\\|"), lambda p: collapse(p)), lambda p: p != "")
    grouped = F.filter(parts, lambda p: p.rlike("(?i)\\bgroup\\b"))
    several = F.size(parts) >= 2
    before = strip(F.regexp_replace(collapse("name"), "(?i)[\\s,(]*(p[- ]?values?|p meta|meta p|p|pval|or|odds ratio|beta|β|hr|hazard ratio|z[- ]?score|effect|95\\s*%?\\s*ci|ci|snp|rsid)[\\s)]*(\\(.*\\))?$", ""))
    label = F.coalesce(F.get(grouped, F.lit(0)), F.when(several, F.get(parts, F.size(parts) - 2)), before)
    rows = columns.select("table_id", "col_idx", "name", metric.alias("metric"), label.alias("label"), (several | (F.size(grouped) > 0)).alias("structured")).where("metric is not null and label != ''")
    meta = F.contains(normalize("name"), F.lit("p meta")) & (F.col("metric") == "p")
    best = rows.groupBy("table_id", "label", "metric").agg(
        F.coalesce(F.max_by(F.when(meta, F.col("name")), F.when(meta, F.col("col_idx"))), F.min_by("name", "col_idx")).alias("name"), F.max("structured").alias("structured")
    )
    w = Window.partitionBy("table_id", "label")
    kinds = F.collect_set("metric").over(w)
    kept = (F.max("structured").over(w) & F.arrays_overlap(kinds, F.array(F.lit("p"), F.lit("effect"), F.lit("ci")))) | ((F.size(kinds) >= 2) & F.arrays_overlap(kinds, F.array(F.lit("effect"), F.lit("ci"))))
    return best.withColumn("kept", kept).where("kept").select("table_id", "label", "metric", "name")


def pipe_columns(columns: DataFrame) -> DataFrame:
    """(table_id, section, subgroup, metric, name) of "section | subgroup | metric" headers; the right-most wins."""
    parts = F.transform(F.split("name", "\\|"), lambda p: collapse(p))
    rows = columns.where(F.size(F.split("name", "\\|")) >= 3).select("table_id", "col_idx", "name", F.get(parts, F.lit(0)).alias("section"), F.get(parts, F.lit(1)).alias("subgroup"), F.lower(F.get(parts, F.size(parts) - 1)).alias("metric"))
    return rows.groupBy("table_id", "section", "subgroup", "metric").agg(F.max_by("name", "col_idx").alias("name"))


def roles(columns: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_id, role, col_idx, name): the right-most column of each substring role, and the p-value and effect columns."""
    n = normalize("name")
    picks = []
    for role, words in (patterns or rules.ROLE_PATTERNS).items():
        hit = holds(n, words)
        picks.append(F.struct(F.lit(role).alias("role"), F.max(F.when(hit, F.struct("col_idx", "name"))).alias("at")))
    p, e = p_value_tier(F.col("name")), effect_tier(F.col("name"))
    for role, tier in (("p", p), ("effect", e)):
        best = F.max(F.when(tier.isNotNull(), F.struct((-tier).alias("tier"), F.struct("col_idx", "name").alias("at"))))
        picks.append(F.struct(F.lit(role).alias("role"), best["at"].alias("at")))
    found = columns.groupBy("table_id").agg(F.array(*picks).alias("roles"))
    return found.select("table_id", F.explode("roles").alias("r")).where("r.at is not null").select("table_id", "r.role", "r.at.col_idx", "r.at.name")


RULE = "role string, tier int, pattern string, unless string, side string"

#: Rules that are broadcast; a table of more is an error.
MOST_RULES = 10_000


def role_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table (RULE), to be changed and given to roles_by_rules or extract.records. A header fits a rule if, normalised, it matches the pattern (a Java expression, found
    anywhere) and not `unless`; of a table's headers the one of the least tier is chosen, and of those the last, or the first where side says so."""
    rows = [(role, 1, "|".join(f"\\Q{w}\\E" for w in words), None, "last") for role, words in rules.ROLE_PATTERNS.items()]
    rows += [(role, tier, pattern, unless, "last") for role, tiers in rules.RANKED_ROLES.items() for tier, pattern, unless in tiers]
    return spark.createDataFrame(rows, RULE)


def roles_by_rules(columns: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(table_id, role, col_idx, name) of columns(table_id, col_idx, name) by a table of rules (RULE).

    Each distinct header meets the rules once; what it fits comes back to the columns as one row for each header, so a header that most tables have is a long key of few bytes, which
    adaptive execution splits. A rule without role, tier or pattern, or of another side, is a ValueError, and so are more than MOST_RULES."""
    faulty = F.col("role").isNull() | F.col("tier").isNull() | F.col("pattern").isNull() | ~F.coalesce("side", F.lit("last")).isin("first", "last")
    n, wrong = rule_table.agg(F.count("*"), F.count_if(faulty)).first()
    if wrong or n > MOST_RULES:
        raise ValueError(f"{wrong} faulty rules" if wrong else f"{n} rules, at most {MOST_RULES}")
    r = F.broadcast(rule_table.select("role", "tier", "pattern", "unless", (F.coalesce("side", F.lit("last")) == "first").alias("first")))
    heads = columns.select("name").distinct().withColumn("__n", normalize("name"))
    fits = F.rlike(F.col("__n"), F.col("pattern")) & ~F.coalesce(F.rlike(F.col("__n"), F.col("unless")), F.lit(False))
    hits = heads.join(r, fits).groupBy("name").agg(F.collect_set(F.struct("role", "tier", "first")).alias("hits"))
    found = columns.select("table_id", "col_idx", "name").join(hits, "name").select("table_id", "col_idx", "name", F.explode("hits").alias("h"))
    place = F.when(F.col("h.first"), -F.col("col_idx")).otherwise(F.col("col_idx"))
    best = found.groupBy("table_id", F.col("h.role").alias("role")).agg(F.max_by(F.struct("col_idx", "name"), F.struct((-F.col("h.tier")).alias("t"), place.alias("p"))).alias("at"))
    return best.select("table_id", "role", "at.col_idx", "at.name")


def spelt_out(c: Column | str) -> Column:
    """Distinct words with abbreviations spelt out; capitals of the long forms part words (a quirk kept)."""
    return F.array_distinct(F.filter(F.split(expand_abbreviations(normalize(c)), "[^a-z0-9]+"), lambda x: x != ""))


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with score: the larger of the matching-blocks ratio of the normalised texts and the Jaccard of their words.

    The ratio has no built-in; it runs in Arrow batches over distinct headers only."""
    shown = pairs.withColumns({"__a": normalize(a), "__b": normalize(b), "__ta": spelt_out(a), "__tb": spelt_out(b)})
    union = F.size(F.array_union("__ta", "__tb"))
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("__ta", "__tb")).cast("double"), union.cast("double")), F.lit(0.0))

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda p, q: SequenceMatcher(None, p, q).ratio())

    return shown.withColumn("score", F.greatest(ratio("__a", "__b"), jaccard)).drop("__a", "__b", "__ta", "__tb")


def map_to_prompts(headers: DataFrame, prompts: dict[str, str] | None = None, threshold: float = 0.4) -> DataFrame:
    """headers(name): the best reference column of each, of any of its levels between bars (hint), the first of equals; below the threshold UNMAPPED and for review. The prompts
    are a fixed, short list."""
    prompts = prompts or rules.COLUMN_PROMPTS
    items = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("target"), F.lit(f"{k}: {v}").alias("prompt")) for i, (k, v) in enumerate(prompts.items())])
    levels = F.filter(F.transform(F.split("name", "\\|"), strip), lambda x: x != "")
    options = F.when(F.contains("name", F.lit("|")), levels).otherwise(F.array("name"))
    pairs = headers.select("name").distinct().select("name", F.posexplode(options).alias("level", "hint")).select("name", "level", "hint", F.explode(items).alias("x")).select("name", "level", "hint", "x.*")
    scored = similarity(pairs, "hint", "prompt")
    best = scored.groupBy("name").agg(F.max_by(F.struct("target", "score", "hint"), F.struct("score", (-F.col("level")).alias("l"), (-F.col("place")).alias("p"))).alias("b"))
    sure = F.col("b.score") >= threshold
    return best.select("name", F.when(sure, F.col("b.target")).otherwise(F.lit("UNMAPPED")).alias("mapped"), F.round("b.score", 4).alias("score"), (~sure).alias("needs_review"), F.when(F.col("b.score") > 0, F.col("b.hint")).otherwise("").alias("hint"))


def table_type(cells: DataFrame) -> DataFrame:
    """(table_id, kind) by the words of a table's first row."""
    text = F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]), " "))
    first = cells.where("row_idx = 0").groupBy("table_id").agg(text.alias("t"))
    has = lambda w: F.contains(F.col("t"), F.lit(w))
    return first.select("table_id", F.when(has("hazard") | has("hr"), "survival").when(has("or") & has("p"), "or_table").when(has("beta") | has("β"), "beta_table").otherwise("unknown").alias("kind"))
