"""Paper-level context from document text: sections, snippets, rule classifiers. Rules are data; each text is read once for all words of all rules (`mentions`), the rest is expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.text import collapse, normalize, strip, text
from litgrid.operators import mentions as mt
from litgrid.operators.mentions import Said, snippets
from litgrid.plans import rules


def finding(value: Column, confidence: Column, review: Column, rule: Column | str, evidence: Column | None = None) -> Column:
    """One inferred field with its confidence, evidence and review flag."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(value.alias("value"), confidence.cast("double").alias("confidence"), (evidence if evidence is not None else F.lit("")).alias("evidence"), rule.alias("rule"), review.alias("needs_review"))


def contains_any(t: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))


def sections(docs: DataFrame, key: str = "doc_id", body: str = "text", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, section, content): lines under each heading, and all lines under "all".

    A short line that equals a heading's alias opens a section and is dropped. Lines before any heading stand in "all" twice, as in the rules
    this follows. A text's lines are read once, and no shuffle is needed.
    """
    aliases = aliases or rules.SECTION_ALIASES
    names = [*aliases, "all"]
    each = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("section"), mt.section_texts(text(body), aliases).alias("content"))
    return docs.select(key, F.explode(each).alias("x")).select(key, F.col("x.section").alias("section"), F.col("x.content").alias("content")).where("content != ''")


def scoped(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scope): methods, results and supplement, or everything where there are none."""
    at = lambda s: F.max(F.when(F.col("section") == s, F.col("content")))
    wide = parts.groupBy(key).agg(*[F.coalesce(at(s), F.lit("")).alias(s) for s in ("methods", "results", "supplement", "all")])
    joined = strip(F.concat_ws("\n", "methods", "results", "supplement"))
    return wide.select(key, F.when(joined != "", joined).otherwise(F.col("all")).alias("scope"))


def flat_words(*lists) -> list[str]:
    """Distinct words of lists and of dictionaries of lists, in order."""
    return list(dict.fromkeys(w for x in lists for own in (x.values() if isinstance(x, dict) else [x]) for w in own))


def first_label(t: Column, labels: dict[str, list[str]], confidence: float, missing: float, rule: Column | str, no_rule: str = "", said: Said | None = None) -> Column:
    """The first label one of whose words the text holds; always for review. {} in the rule stands for the label. said: what the evidence is cut from."""
    held = said or Said(t, mt.mentions(t, flat_words(labels)), tuple(flat_words(labels)))
    value, evidence = F.lit(None).cast("string"), F.lit("")
    for label in reversed(labels):
        hit = held.any(labels[label])
        value = F.when(hit, F.lit(label)).otherwise(value)
        if said is not None:
            # the word that decides is the first of the label's words that the normalised text holds
            evidence = F.when(hit, said.first(labels[label], normalised=True)).otherwise(evidence)
    found = value.isNotNull()
    told = F.when(found, F.replace(F.lit(rule), F.lit("{}"), F.coalesce(value, F.lit("")))).otherwise(F.lit(no_rule or rule))
    return finding(F.coalesce(value, F.lit("NR")), F.when(found, confidence).otherwise(missing), F.lit(True), told, evidence)


def vocabulary() -> list[str]:
    """All words of the rules: what a text is read for."""
    heads = [label.split()[0] for label in rules.POPULATIONS]
    return flat_words(rules.ASSOCIATION_TYPES, rules.IMPUTATION_WORDS, rules.PANELS, rules.STAGE_CUES, rules.STAGE_EVIDENCE, rules.MODEL_FAMILIES, rules.COVARIATES, rules.MODEL_EVIDENCE, rules.POPULATIONS, heads)


def evidence_asked() -> list[mt.Evidence]:
    lists = [rules.IMPUTATION_WORDS, rules.STAGE_EVIDENCE, rules.MODEL_EVIDENCE, *[[label.split()[0]] for label in rules.POPULATIONS]]
    return [*[mt.Evidence(tuple(words)) for words in lists], *[mt.Evidence(tuple(words), True) for words in rules.ASSOCIATION_TYPES.values()]]


def heard(body: Column | Said) -> Said:
    """The body's reading for all rules."""
    if isinstance(body, Said):
        return body
    words, asked = vocabulary(), evidence_asked()
    return Said(F.coalesce(text(body), F.lit("")), mt.reading(body, words, asked), tuple(words), tuple(asked))


# Fixed values from here on: the values, confidences, rules and evidence words of published curation rules.


def association_type(body: Column | Said) -> Column:
    said = heard(body)
    return first_label(said.body, rules.ASSOCIATION_TYPES, 0.7, 0.25, "matched association keywords -> {}", "no association cues found", said)


def imputation(body: Column | Said) -> Column:
    said = heard(body)
    panels = F.concat_ws(";", *[F.when(said.alone(words), F.lit(name)) for name, words in rules.PANELS.items()])
    n = reduce(add, [said.alone(words).cast("int") for words in rules.PANELS.values()])
    snippet = said.first(rules.IMPUTATION_WORDS)
    evidence = F.when((n > 0) & (snippet == ""), "Detected panel keywords in text.").otherwise(snippet)
    one = "panel keyword detection (TOPMed/HRC/1000G)"
    rule = F.when(n > 1, one + " (multiple panels; table-specific mapping unclear)").when(n == 1, one).otherwise("no imputation keywords found")
    return finding(F.when(n > 0, panels).otherwise("NR"), F.when(n > 1, 0.65).when(n == 1, 0.85).otherwise(0.3), n != 1, rule, evidence)


STAGES = [
    ("meta-analysis", "Meta-analysis", 0.8, "found meta-analysis cues"),
    ("joint-analysis", "Joint-analysis", 0.75, "found joint-analysis cues"),
    ("stage 1", "Stage 1/2", 0.7, "explicit Stage 1/2 detected; mapping needs confirmation"),
    ("stage 2", "Stage 1/2", 0.7, "explicit Stage 1/2 detected; mapping needs confirmation"),
    ("replication", "Replication/Validation", 0.7, "found replication cues"),
    ("discovery", "Discovery", 0.6, "found generic discovery/GWAS cues"),
]


def by_priority(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for hit, value in reversed(cases):
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def stage(body: Column | Said) -> Column:
    said = heard(body)
    cues = [(said.any(rules.STAGE_CUES[cue]), *rest) for cue, *rest in STAGES]
    value = by_priority([(hit, v) for hit, v, _, _ in cues], "NR")
    confidence = by_priority([(hit, c) for hit, _, c, _ in cues], 0.25)
    rule = by_priority([(hit, r) for hit, _, _, r in cues], "no stage cues found")
    return finding(value, confidence, value != "Meta-analysis", rule, said.first(rules.STAGE_EVIDENCE))


def model_type(body: Column | Said) -> Column:
    said = heard(body)
    family = F.lit(None).cast("string")
    for name in reversed(rules.MODEL_FAMILIES):
        family = F.when(said.any(rules.MODEL_FAMILIES[name]), F.lit(name)).otherwise(family)
    known, adjusted = family.isNotNull(), said.any(rules.COVARIATES)
    value = F.when(known & adjusted, F.concat(family, F.lit(" regression (with covariates)"))).when(known, F.concat(family, F.lit(" regression"))).when(adjusted, "model with covariates (family NR)").otherwise("NR")
    confidence = by_priority([(known & adjusted, 0.75), (known, 0.65), (adjusted, 0.55)], 0.25)
    rule = by_priority([(known & adjusted, "model family + covariate cues"), (known, "model family cues only"), (adjusted, "covariate cues only")], "no model cues")
    return finding(value, confidence, F.lit(True), rule, said.first(rules.MODEL_EVIDENCE))


def population(scope: Column | Said) -> Column:
    said = heard(scope)
    value, evidence = F.lit(None).cast("string"), F.lit("")
    for label in reversed(rules.POPULATIONS):
        hit = said.alone(rules.POPULATIONS[label])
        value = F.when(hit, F.lit(label)).otherwise(value)
        evidence = F.when(hit, said.first([label.split()[0]])).otherwise(evidence)
    found = value.isNotNull()
    rule = F.when(found, "section-aware population keyword").otherwise("no population cues found in methods/results/supplement")
    return finding(F.coalesce(value, F.lit("NR")), F.when(found, 0.75).otherwise(0.25), F.lit(True), rule, evidence)


def sample_size(scope: Column) -> Column:
    scope = F.coalesce(scope, F.lit(""))
    found = [(F.regexp_extract(scope, p, 0), F.regexp_extract(scope, p, 1)) for p in rules.SAMPLE_SIZES]
    value = F.replace(F.coalesce(*[F.when(whole != "", n) for whole, n in found]), F.lit(","), F.lit(""))
    whole = F.coalesce(*[F.when(w != "", w) for w, _ in found], F.lit(""))
    at = F.position(F.lower(whole), F.lower(scope))
    begin = F.greatest(at - 1 - 180, F.lit(0))
    evidence = F.when(whole != "", F.replace(F.substring(scope, begin + 1, at - 1 - begin + F.length(whole) + 180), F.lit("\n"), F.lit(" "))).otherwise("")
    rule = F.when(value.isNotNull(), "section-aware sample size extraction").otherwise("no sample size cues found")
    return finding(F.coalesce(value, F.lit("NR")), F.when(value.isNotNull(), 0.7).otherwise(0.25), F.lit(True), rule, evidence)


def publication_ids(body: Column) -> Column:
    """struct(pmcid, pmid, evidence) from a paper's text; NR for what it doesn't tell."""
    t = F.coalesce(text(body), F.lit(""))
    pick = lambda *patterns: F.coalesce(*[F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1)) for p in patterns])
    pmcid = F.upper(pick("(?i)\\bPMCID\\s*[:：]?\\s*(PMC\\d{4,})\\b", "(?i)\\b(PMC\\d{4,})\\b"))
    pmid = pick("(?i)\\bPMID\\s*[:：]?\\s*(\\d{6,10})\\b", "(?i)\\bPubMed\\s*[:：]?\\s*(\\d{6,10})\\b")

    def around(word: Column) -> Column:
        at = F.position(F.lower(word), F.lower(t))
        begin = F.greatest(at - 1 - 80, F.lit(0))
        return F.when(at > 0, F.replace(F.substring(t, begin + 1, at - 1 - begin + F.length(word) + 80), F.lit("\n"), F.lit(" ")))

    return F.struct(F.coalesce(pmcid, F.lit("NR")).alias("pmcid"), F.coalesce(pmid, F.lit("NR")).alias("pmid"), F.coalesce(around(pmcid), around(pmid), F.lit("")).alias("evidence"))


def with_fallback(found: Column, hint: Column, pmid: Column) -> Column:
    """A finding, or what the paper's metadata say where it is NR."""
    known = (found["value"] == "NR") & (F.coalesce(hint, F.lit("")) != "")
    other = finding(hint, F.lit(0.6), F.lit(True), "paper metadata fallback", F.concat(F.lit("paper-level fallback metadata for PMID "), pmid))
    return F.when(known, other).otherwise(found)


def paper_context(docs: DataFrame, key: str = "doc_id", body: str = "text", hints: DataFrame | None = None) -> DataFrame:
    """One row per paper with a finding per field, read from its methods, results and supplement, or from all of it where there are none. hints(pmid, table_idx, field, value):
    a paper's own fill imputation and population where the text tells nothing."""
    # all of it within the row: a text is split and read where it lies
    parts = docs.select(key, F.coalesce(text(body), F.lit("")).alias("__body"), mt.section_texts(text(body), rules.SECTION_ALIASES).alias("__parts"))
    own = strip(F.concat_ws("\n", *[F.get("__parts", F.lit(i)) for i in range(len(rules.SECTION_ALIASES))]))
    ready = parts.withColumn("__own", own).select(key, F.when(F.col("__own") != "", F.col("__own")).otherwise(F.col("__body")).alias("__full"), F.when(F.col("__own") != "", F.col("__own")).otherwise(F.element_at("__parts", -1)).alias("__scope"))
    ready = ready.withColumns({"__of_full": heard(F.col("__full")).found, "__of_scope": heard(F.col("__scope")).found})
    t, scope = (Said(F.col(f"__{n}"), F.col(f"__of_{n}"), tuple(vocabulary()), tuple(evidence_asked())) for n in ("full", "scope"))
    found = ready.select(key, imputation(t).alias("imputation"), stage(t).alias("stage"), association_type(t).alias("association"), model_type(t).alias("model"), population(scope).alias("population"), sample_size(scope.body).alias("sample_size"))
    if hints is None:
        return found
    fields = {"imputation": "Imputation_simple2", "population": "Population"}
    said = hints.where("table_idx is null").groupBy(F.col("pmid").alias("__pmid")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{n}") for n, f in fields.items()])
    filled = found.join(F.broadcast(said), F.col(key).cast("string") == F.col("__pmid"), "left")
    return filled.withColumns({n: with_fallback(F.col(n), F.col(f"__{n}"), F.col(key).cast("string")) for n in fields}).select(*found.columns)


def has_signal(body: Column) -> Column:
    t = normalize(body)
    return (F.length(t) >= 500) & F.contains(t, F.lit("methods")) & F.contains(t, F.lit("results"))


def text_with_fallback(first: Column, *others: tuple[str, Column], name: str = "pdf") -> tuple[Column, Column]:
    """(text, source): the first text unless another has the signal it lacks, or is over 500 characters longer."""
    best, source = F.coalesce(first, F.lit("")), F.lit(name)
    for label, other in others:
        other = F.coalesce(other, F.lit(""))
        better = ~has_signal(best) & (has_signal(other) | (F.length(other) > F.length(best) + 500))
        best, source = F.when(better, other).otherwise(best), F.when(better, F.lit(label)).otherwise(source)
    return best, source


def cohort_votes(docs: DataFrame, synonyms: dict[str, str], key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, cohort, n): mentions of each code; counted per paper once, not per record."""
    found = mt.mentions(F.lower(F.coalesce(text(body), F.lit(""))), list(synonyms))
    codes = F.array(*[F.lit(v) for v in synonyms.values()])
    each = docs.select(key, found.alias("__found")).select(key, F.explode(F.arrays_zip("__found.words", "__found.counts")).alias("x"))
    return each.groupBy(key, F.get(codes, F.col("x.words")).alias("cohort")).agg(F.sum(F.col("x.counts").cast("bigint")).alias("n"))


def dominant(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cohort): the leading code where it has max(2, second + 1) votes."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "cohort")
    ranked = votes.withColumns({"r": F.row_number().over(w), "second": F.coalesce(F.lead("n").over(w), F.lit(0))})
    return ranked.where((F.col("r") == 1) & (F.col("n") >= F.greatest(F.lit(2), F.col("second") + 1))).select(key, "cohort", "n")


def with_hints(records: DataFrame, hints: DataFrame, paper: str, table: str, fields: list[str]) -> DataFrame:
    """Fields from metadata hints where the record has none: a table's hint goes before its paper's. hints(pmid, table_idx, field, value)."""
    wide = lambda rows, p: rows.groupBy("pmid", *(["table_idx"] if p == "t" else [])).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{p}_{i}") for i, f in enumerate(fields)])
    own = wide(hints.where("table_idx is not null"), "t").withColumnsRenamed({"pmid": "__tp", "table_idx": "__ti"})
    common = wide(hints.where("table_idx is null"), "g").withColumnsRenamed({"pmid": "__gp"})
    joined = records.join(own, (F.col(paper) == F.col("__tp")) & (F.col(table) == F.col("__ti")), "left").join(common, F.col(paper) == F.col("__gp"), "left")
    blank = lambda c: F.upper(collapse(c)).isin("", "NR")
    filled = {f: F.when(blank(f), F.coalesce(f"__t_{i}", f"__g_{i}", f)).otherwise(F.col(f)) for i, f in enumerate(fields)}
    return joined.withColumns(filled).select(*records.columns)


def codes_in(t: Column, synonyms: dict[str, str]) -> Column:
    """Distinct codes of the synonyms that a short text holds, in vocabulary order."""
    return F.array_distinct(F.filter(F.array(*[F.when(F.contains(t, F.lit(k)), F.lit(v)) for k, v in synonyms.items()]), lambda x: x.isNotNull()))


def record_cohorts(records: DataFrame, row: str, place: str, papers: DataFrame, key: str = "paper_id", body: str = "text", synonyms: dict[str, str] | None = None) -> DataFrame:
    """records with cohort_found: codes of the row, else those near its table's mentions (only the leading one if there is one), else those of the whole text; rows about
    expression also have ADNI, rows about disease associations IGAP.

    records(key, row, place) hold the row's own text and the table's name, papers(key, body) a paper's text. Papers are read once into an index of mentions; its windows around tables
    are joined with its mentions of codes by offsets, and only what they count comes to the records.
    """
    synonyms = synonyms or rules.COHORT_SYNONYMS
    codes = list(dict.fromkeys(synonyms.values()))
    of_word = F.array(*[F.lit(codes.index(v)) for v in synonyms.values()])
    # three answers are drawn from it
    found = mt.index(papers, key, body, list(synonyms)).persist()
    by_code = mt.within(found, key).groupBy(key, "place", F.get(of_word, F.col("word")).alias("__i")).agg(F.sum("n").alias("__n"))
    named = F.array(*[F.lit(c) for c in codes])
    near = by_code.groupBy(key, F.col("place").alias("__place")).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__i").alias("i"), F.get(named, F.col("__i")).alias("code")))).alias("__near"))
    whole = found.where("word is not null").groupBy(key).agg(F.collect_set("word").alias("__held"))
    ready = records.withColumn("__place", normalize(place))
    joined = ready.join(near, [key, "__place"], "left").join(whole, key, "left").select(*records.columns, F.coalesce("__near", F.expr("cast(array() as array<struct<n:bigint,i:int,code:string>>)")).alias("__near"), F.coalesce("__held", F.expr("cast(array() as array<int>)")).alias("__held"))
    own = normalize(row)
    joined = joined.withColumn("__named", F.transform(F.sort_array(F.transform("__near", lambda x: F.struct(x["i"], x["code"]))), lambda x: x["code"]))
    of_row = codes_in(own, synonyms)
    first, second = F.get("__near", F.lit(0)), F.get("__near", F.lit(1))
    leading = (F.size("__near") > 1) & (-first["n"] >= F.greatest(F.lit(2), 1 - second["n"]))
    of_table = F.when(leading, F.array(first["code"])).otherwise(F.col("__named"))
    of_text = F.array_distinct(F.filter(F.array(*[F.when(F.array_contains("__held", F.lit(i)) & ~F.contains(own, F.lit(k)), F.lit(v)) for i, (k, v) in enumerate(synonyms.items())]), lambda x: x.isNotNull()))
    by_row, by_table = F.size(of_row) > 0, F.size("__named") > 0
    hits = F.when(by_row, of_row).when(by_table, of_table).otherwise(of_text)
    also = F.array(F.when(F.contains(own, F.lit("eqtl")), F.lit("ADNI")), F.when(F.contains(own, F.lit("ad association")) | F.contains(own, F.lit("disease association")), F.lit("IGAP")))
    codes = F.array_distinct(F.concat(hits, F.filter(also, lambda x: x.isNotNull())))
    # Fixed values from here on: confidences and evidence texts.
    n, value = F.size(codes), F.array_join(codes, ";")
    one = F.get(codes, F.lit(0))
    cases = [
        (n == 0, 0.25, F.lit("")),
        (by_row & (n == 1), 0.9, F.concat(F.lit("row context matched cohort keyword -> "), one)),
        (by_row, 0.65, F.concat(F.lit("multiple row cohort hits: "), value)),
        (by_table & (n == 1), 0.8, F.concat(F.lit("table-local context matched cohort keyword -> "), one)),
        (by_table, 0.6, F.concat(F.lit("multiple table-local cohort hits: "), value)),
        (n == 1, 0.6, F.concat(F.lit("full text matched cohort keyword -> "), one)),
    ]
    evidence, confidence = F.concat(F.lit("multiple full-text cohort hits: "), value), F.lit(0.45)
    for hit, c, said in reversed(cases):
        evidence, confidence = F.when(hit, said).otherwise(evidence), F.when(hit, F.lit(c)).otherwise(confidence)
    told = finding(F.when(n > 0, value).otherwise("NR"), confidence, ~((n == 1) & (by_row | by_table)), "row, table mentions, text", evidence)
    return joined.withColumn("cohort_found", told).drop("__near", "__named", "__held")
