"""Association records from tables of known and unknown layouts.

A table row is one row with an array of values, made by a single aggregation. What a layout needs to know of a table - is it of this layout, which place holds
what, which groups of columns give a record each - follows from the headers alone, so it is worked out once per table, as one row for each record that a table
row can give. These rows are joined to the table's rows, and a record is then plain expressions over the cells at those places. The first layout in
order with a record wins for its table, and the generic layout takes the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions import numbers as num
from litgrid.functions import text as tx
from litgrid.operators import headers
from litgrid.plans import rules

#: Fields of a record and the curated columns they fill.
FIELDS = {
    "name": "Name", "top_snp": "TopSNP", "kind": "SNP-based, Gene-based", "chrom": "Chr", "bp": "BP(Position)", "ra1": "RA 1(Reported Allele 1)", "ra2": "RA 2(Reported Allele 2)", "maf": "ReportedAF(MAF)",
    "effect_type": "Effect Size Type (OR or Beta)", "effect_raw": "EffectSize(altvsref)", "ci": "95%ConfidenceInterval", "p_raw": "P-value", "p_note": "P-value note", "grp": "Analysis group", "phenotype": "Phenotype",
    "phenotype_derived": "Phenotype-derived", "plot": "For plotting Beta and OR - derived", "locus": "LocusName", "gene": "Reported gene (gene based test)", "cohort": "Cohort", "sample_size": "Sample size", "population": "Population",
    "imputation": "Imputation_simple2", "notes": "Notes", "interactions": "Interactions", "model": "Model type",
}


def grid(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, row_idx, raw, heads, vals): headers as written, normalised headers and values of each row, in column order."""
    joined = cells.join(columns, ["table_id", "col_idx"])
    rows = joined.groupBy("table_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", "name", tx.cell("value").alias("value")))).alias("x"))
    return rows.select("table_id", "row_idx", F.transform("x", lambda x: x["name"]).alias("raw"), F.transform("x", lambda x: tx.normalize(x["name"])).alias("heads"), F.transform("x", lambda x: x["value"]).alias("vals"))


def places_of(test) -> Column:
    """Places whose header passes the test."""
    return F.filter(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: test(F.get("heads", i)))


def holding(*words: str):
    return lambda h: reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in words])


def first(*words: str) -> Column:
    return F.get(places_of(holding(*words)), F.lit(0))


def last(*words: str) -> Column:
    return F.try_element_at(places_of(holding(*words)), F.lit(-1))


def exact(word: str) -> Column:
    return F.get(places_of(lambda h: h == word), F.lit(0))


def at(place: Column) -> Column:
    """The value at a place; blank without a place."""
    return F.coalesce(F.get("vals", place), F.lit(""))


def any_head(test) -> Column:
    return F.exists("heads", test)


def record(**fields: Column) -> Column:
    """A record; fields not given are blank. effect and p hold numbers, effect_raw and p_raw what stands in the sheet."""
    blank = F.lit("")
    numbers = [F.coalesce(fields.get(n, F.lit(None)), F.lit(None)).cast("double").alias(n) for n in ("effect", "p")]
    texts = [F.coalesce(fields.get(n, blank).cast("string"), blank).alias(n) for n in FIELDS]
    return F.struct(*texts, *numbers, fields.get("confidence", F.lit(0.4)).cast("double").alias("confidence"), fields.get("keep", F.lit(True)).alias("keep"))


def shown(value: Column, raw: Column) -> Column:
    """The raw text where there is no number."""
    return F.coalesce(value.cast("string"), raw)


def has_rs(snp: Column, whole: bool = True) -> Column:
    return snp.rlike("(?i)^rs\\d+$" if whole else "(?i)\\brs\\d+\\b")


def ratio(raw: Column, kind: str = "OR") -> tuple[Column, Column]:
    """(effect, interval) of an effect cell."""
    return F.coalesce(num.effect_of(raw), num.safe_float(raw)), num.interval_of(raw, F.lit(kind))


def statistics(or_place: Column, p_place: Column, kind: str = "OR") -> dict[str, Column]:
    effect_raw, p_raw = at(or_place), at(p_place)
    effect, ci = ratio(effect_raw, kind)
    p = num.safe_float(p_raw)
    return {"effect": effect, "effect_raw": effect.cast("string"), "ci": ci, "p": p, "p_raw": p.cast("string"), "effect_type": F.lit(kind), "keep": ~(tx.looks_missing(effect_raw) & tx.looks_missing(p_raw))}


class Layout(NamedTuple):
    """detected: is a table of this layout; places: columns of a table, by name; each: an array of structs, one for each record of a row; all over a table's raw and heads.
    record: a record over vals, the places (as columns) and g, one of the structs."""

    detected: Column
    places: dict[str, Column]
    each: Column | None
    record: Callable[[], Column]


def value_of(place: str) -> Column:
    """The row's value at a named place, or at one of the record's own (g.name)."""
    return at(F.col(place))


def all_found(places: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in places.values()])


def fixed_structs(names: list[str], rows: list[tuple]) -> Column:
    """An array of structs of constants."""
    typed = lambda v: F.lit(v).cast("int") if v is None else F.lit(v)
    return F.array(*[F.struct(*[typed(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def pipe_layout() -> Layout:
    """section | subgroup | metric headers with a rs id."""
    parts = F.transform("raw", lambda r: F.transform(F.split(r, "\\|"), tx.collapse))
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.size(p).alias("n"), F.get(p, F.lit(0)).alias("section"), F.get(p, F.lit(1)).alias("subgroup"), F.lower(F.element_at(p, -1)).alias("metric")))
    grouped = F.filter(placed, lambda x: x["n"] >= 3)
    pairs = F.array_distinct(F.transform(grouped, lambda x: F.struct(x["section"].alias("section"), x["subgroup"].alias("subgroup"))))

    def one(g: Column) -> Column:
        hits = lambda test, own: F.transform(F.filter(grouped, lambda x: (x["section"] == g["section"]) & x["metric"].rlike(test) & ((x["subgroup"] == g["subgroup"]) if own else F.lit(True))), lambda x: x["i"])
        mine, of_section = (lambda test: F.try_element_at(hits(test, True), F.lit(-1))), (lambda test: F.get(hits(test, False), F.lit(0)))
        found = {
            "snp": F.coalesce(mine("\\bsnp\\b"), of_section("\\bsnp\\b")), "gene": F.coalesce(mine("gene"), of_section("gene"), F.col("near_gene")),
            "or": mine("\\bor\\b|odds ratio"), "p": mine("\\bp\\b|p[- ]value"), "chr": F.coalesce(mine("chr"), F.col("any_chr")), "bp": F.coalesce(mine("pos|\\bbp\\b"), F.col("any_bp")),
        }
        return F.struct(g["section"].alias("section"), g["subgroup"].alias("subgroup"), *[c.cast("int").alias(n) for n, c in found.items()])

    def made() -> Column:
        snp, gene = tx.sanitize_topsnp(value_of("g.snp")), tx.sanitize_locus(value_of("g.gene"))
        stats = statistics(F.col("g.or"), F.col("g.p"))
        keep = stats.pop("keep") & has_rs(snp, False)
        return record(name=gene, top_snp=snp, kind=F.lit("SNP-based"), locus=gene, chrom=value_of("g.chr"), bp=value_of("g.bp"), grp=F.regexp_replace(F.col("g.subgroup"), "(?i)\\s+[a-z]$", ""), confidence=F.lit(0.7), keep=keep, **stats)

    # places that no group has of its own
    places = {"near_gene": first("closest gene", "nearest gene"), "any_chr": first("chr"), "any_bp": first("position", "bp")}
    return Layout(F.size(grouped) > 0, places, F.transform(pairs, one), made)


def two_block_layout() -> Layout:
    """Two blocks by place: four columns and five, the second with two groups."""
    detected = any_head(lambda h: h.startswith("igap snp")) & any_head(lambda h: h.startswith("exonic snp")) & (F.size("heads") >= 9)
    each = fixed_structs(["section", "label", "snp", "or", "p"], [("IGAP SNP", "ADGC", 0, 2, 3), ("Exonic SNP", "ADGC", 4, 5, 6), ("Exonic SNP", "ADSP", 4, 7, 8)])

    def made() -> Column:
        linked = F.contains(F.lower(F.array_join("vals", " | ")), F.lit("strong ld"))
        snp = tx.sanitize_topsnp(value_of("g.snp"))
        stats = statistics(F.col("g.or"), F.col("g.p"))
        keep = stats.pop("keep") & has_rs(snp) & ~linked
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), locus=tx.sanitize_locus(at(F.lit(1))), grp=F.col("g.label"), p_note=F.concat_ws(" ", "g.section", "g.label", F.lit("P-value")), confidence=F.lit(0.8), keep=keep, **stats)

    return Layout(detected, {}, each, made)


def filled(value: Column) -> Column:
    """The last value down the table so far; blanks don't count."""
    w = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(value != "", value), ignorenulls=True).over(w), F.lit(""))


def survival_interval(raw: Column) -> Column:
    ci = F.replace(raw, F.lit(";"), F.lit(", "))
    return F.when((ci != "") & ~ci.startswith("("), F.concat(F.lit("("), ci, F.lit(")"))).otherwise(ci)


def survival_layout() -> Layout:
    """Hazard ratios by stratum, with numbers of observations; stratum, variant, cohort and number are carried down."""
    needed = {"snp": first("snp (rs)", "snp", "rsid"), "cohort": first("studies combined", "cohort", "study"), "size": first("number of observations"), "model": first("model"), "hr": first("hazard ratio"), "ci": first("95 % ci", "95% ci", "confidence interval"), "p": first("p-value", "p value")}

    def made() -> Column:
        snp, cohort, size = filled(tx.sanitize_topsnp(value_of("snp"))), filled(value_of("cohort")), filled(value_of("size"))
        stratum, hr_raw, p_raw = filled(value_of("stratum")), value_of("hr"), value_of("p")
        hr = num.safe_float(hr_raw)
        keep = ~tx.looks_missing(snp) & ~(tx.looks_missing(hr_raw) & tx.looks_missing(p_raw))
        # Fixed value: a locus that the source names outside the table
        locus = F.when(snp == "rs146729640", "SHISA6").otherwise("")
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), cohort=cohort, sample_size=size, grp=F.lit("All"), phenotype_derived=F.lit("Age at onset of cognitive impairment (CI)"), effect_type=F.lit("HR"), effect=hr, effect_raw=shown(hr, hr_raw), ci=survival_interval(value_of("ci")), p=num.safe_float(p_raw), p_raw=p_raw, locus=locus, notes=stratum, model=value_of("model"), confidence=F.lit(0.8), keep=keep)

    return Layout(all_found(needed), needed | {"stratum": first("apoe4 stratification", "stratification", "group")}, None, made)


def hazard_layout() -> Layout:
    """Hazard ratios by stratum with places as chr:pos_REF_ALT and two group sizes."""
    snp = F.coalesce(first("snp (rs)", "variant (rs)", "rs-id", "rsid"), first("snp"))
    needed = {"stratum": first("apoe4 stratification"), "place": first("snp (chr:pos)", "variant", "chr:position"), "snp": snp, "n_ci": first("n (ci)", "n(ci)"), "n_cu": first("n (cu)", "n(cu)"), "hr": first("hazard ratio"), "ci": first("hazard ratio 95% ci", "hazard ratio 95 % ci"), "p": first("p-value", "p value")}

    def made() -> Column:
        chrom, bp, ra1, ra2 = num.location_alleles(value_of("place"))
        snp, hr_raw, p_raw = tx.sanitize_topsnp(value_of("snp")), value_of("hr"), value_of("p")
        hr = num.safe_float(hr_raw)
        size = F.array_join(F.filter(F.array(value_of("n_ci"), value_of("n_cu")), lambda x: x != ""), "/")
        keep = ~tx.looks_missing(snp) & ~(tx.looks_missing(hr_raw) & tx.looks_missing(p_raw))
        group = F.when(value_of("stratum") != "", value_of("stratum")).otherwise("All")
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), chrom=chrom, bp=bp, ra1=ra1, ra2=ra2, sample_size=size, grp=group, phenotype_derived=F.lit("Age at onset of cognitive impairment (CI)"), effect_type=F.lit("HR"), effect=hr, effect_raw=shown(hr, hr_raw), ci=survival_interval(value_of("ci")), p=num.safe_float(p_raw), p_raw=p_raw, locus=tx.sanitize_locus(value_of("gene")), confidence=F.lit(0.82), keep=keep)

    return Layout(all_found(needed), needed | {"gene": first("gene")}, None, made)


def inline_groups_layout() -> Layout:
    """Exact headers with pairs OR, P, OR.1, P.1; the first row names the groups."""
    heads = ["variant", "chr.", "position", "gene symbol", "ea", "or", "p"]
    detected = reduce(lambda a, b: a & b, [F.array_contains("heads", h) for h in heads]) & F.exists("first_vals", lambda v: F.contains(F.lower(v), F.lit("apoe*4")))
    places = {f"x_{k}": exact(h) for k, h in enumerate(heads[:5])}

    def one(i: Column) -> Column:
        follows = F.get("heads", i + 1)
        return F.struct(i.alias("or"), F.when((follows == "p") | follows.startswith("p."), i + 1).alias("p"), F.coalesce(F.get("first_vals", i), F.lit("")).alias("label"))

    def made() -> Column:
        snp, chrom, bp, gene, ea = (value_of(f"x_{k}") for k in range(5))
        snp, or_raw, p_raw = tx.sanitize_topsnp(snp), value_of("g.or"), value_of("g.p")
        effect, p = num.safe_float(or_raw), num.safe_float(p_raw)
        keep = (F.col("row_idx") > F.col("first_row")) & ~tx.looks_missing(snp) & ~(tx.looks_missing(or_raw) & tx.looks_missing(p_raw))
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), chrom=chrom, bp=bp, ra1=ea, locus=tx.sanitize_locus(gene), grp=F.col("g.label"), effect_type=F.lit("OR"), effect=effect, effect_raw=shown(effect, or_raw), p=p, p_raw=shown(p, p_raw), confidence=F.lit(0.8), keep=keep)

    return Layout(detected, places | {"first_row": F.col("first_idx")}, F.transform(places_of(lambda h: (h == "or") | h.startswith("or.")), one), made)


#: Phenotype, place of the effect, place of the p-value, note.
MANY_P = [("AD status", 6, 7, "Univariate AD status P-value"), ("NP", 8, 9, "Univariate NP P-value"), ("NFT", 10, 11, "Univariate NFT P-value"), ("CAA", 12, 13, "Univariate CAA P-value"), ("NP + NFT", None, 15, "Joint NP + NFT P-value"), ("NP + CAA", None, 17, "Joint NP + CAA P-value"), ("NFT + CAA", None, 19, "Joint NFT + CAA P-value")]


def many_p_layout() -> Layout:
    """Twenty columns or more with seven p-values by place."""
    many = lambda test, n: F.size(F.filter("heads", test)) >= n
    flat = (F.slice("heads", 1, 6) == F.array(*[F.lit(x) for x in ("chromosome", "snp", "gene", "ea", "ra", "eaf")])) & many(lambda h: h.startswith("p value"), 7) & many(holding("β value", "beta value"), 4)
    detected = (F.size("heads") >= 20) & (flat | (any_head(holding("univariate models")) & any_head(holding("joint models"))))

    def made() -> Column:
        snp, p, effect = tx.sanitize_topsnp(at(F.lit(1))), num.safe_float(value_of("g.p")), num.effect_of(value_of("g.effect"))
        kind = F.when(F.col("g.effect").isNotNull(), "Beta").otherwise("NR")
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), chrom=tx.integer_like(at(F.lit(0))), locus=tx.sanitize_locus(at(F.lit(2))), ra1=at(F.lit(3)), ra2=at(F.lit(4)), maf=at(F.lit(5)), p=p, p_raw=p.cast("string"), p_note=F.col("g.note"), effect_type=kind, effect=effect, effect_raw=effect.cast("string"), grp=F.col("g.phenotype"), phenotype=F.col("g.phenotype"), phenotype_derived=F.lit("Neuropathology"), confidence=F.lit(0.82), keep=has_rs(snp) & p.isNotNull())

    return Layout(detected, {}, fixed_structs(["phenotype", "effect", "p", "note"], MANY_P), made)


def combination_layout() -> Layout:
    """Combinations of genes with an odds ratio and several p-values; rows of one label name the group below."""
    needed = {"snp": first("gene–gene combination | gene–gene combination", "gene-gene combination | gene-gene combination"), "gene": first("genes included in the combination"), "effect": first("or(95% ci.) | or(95% ci.)", "or (95% ci.) | or (95% ci.)")}
    p_places = places_of(holding("p‐value", "p-value"))
    each = F.transform(p_places, lambda i: F.struct(i.alias("p"), tx.strip(F.element_at(F.split(F.get("raw", i), "\\|"), -1)).alias("sub")))

    def made() -> Column:
        kinds = F.array_distinct(F.filter("vals", lambda v: v != ""))
        label = F.when((F.size(kinds) == 1) & F.contains(F.lower(F.get(kinds, F.lit(0))), F.lit("apoe*4")), F.get(kinds, F.lit(0))).otherwise("")
        group, order, raw, snp, p_raw = filled(label), value_of("order"), value_of("effect"), value_of("snp"), value_of("g.p")
        effect, ci, p = num.effect_of(raw), num.interval_of(raw, F.lit("OR")), num.safe_float(p_raw)
        keep = (label == "") & ~tx.looks_missing(snp) & ~(effect.isNull() & tx.looks_missing(raw)) & ~tx.looks_missing(p_raw)
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), locus=tx.sanitize_locus(value_of("gene")), grp=F.col("g.sub"), notes=F.when(group != "", group).otherwise(order), interactions=order, effect_type=F.lit("OR"), effect=effect, effect_raw=shown(effect, raw), ci=F.when(ci != "", ci).otherwise(raw), p=p, p_raw=shown(p, p_raw), confidence=F.lit(0.8), keep=keep)

    return Layout(all_found(needed) & (F.size(p_places) >= 2), needed | {"order": first("unnamed: 0_level_0 | unnamed: 0_level_1")}, each, made)


def joint_layout() -> Layout:
    """Joint tests by cognitive domain and cohort."""
    names = {"snp": "variant | variant", "gene": "nearest gene | nearest gene", "domain": "cognitive domain | cognitive domain", "cohort": "cohortsb | cohortsb", "effect": "genetic effects | βg (se)", "p": "genetic effects | pjoint"}
    detected = reduce(lambda a, b: a & b, [F.array_contains("heads", h) for h in names.values()])
    places = {n: exact(h) for n, h in (names | {"alleles": "a1/a2a (maf) | a1/a2a (maf)", "chr": "chr | chr", "bp": "position | position"}).items()}

    def made() -> Column:
        domain, cohort, effect_raw, p_raw = value_of("domain"), value_of("cohort"), value_of("effect"), value_of("p")
        snp, effect, p = tx.sanitize_topsnp(value_of("snp")), num.effect_of(effect_raw), num.safe_float(p_raw)
        a1, a2, maf = num.alleles_and_frequency(value_of("alleles"))
        group = F.regexp_replace(F.concat(domain, F.lit(" | "), cohort), "^[ |]+|[ |]+$", "")
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), chrom=value_of("chr"), bp=value_of("bp"), ra1=a1, ra2=a2, maf=maf, locus=tx.sanitize_locus(value_of("gene")), grp=group, phenotype_derived=domain, cohort=cohort, effect_type=F.lit("Beta"), effect=effect, effect_raw=shown(effect, effect_raw), p=p, p_raw=shown(p, p_raw), confidence=F.lit(0.8), keep=~tx.looks_missing(snp))

    return Layout(detected, places, None, made)


def expression_layout() -> Layout:
    """An expression p-value and a disease p-value per row; variant and closest gene are carried down."""
    eqtl = places_of(lambda h: h.startswith("eqtl association"))
    places = {"snp": last("igap snp", "snp"), "disease": last("ad association", "p-value c", "p value c"), "beta": F.get(eqtl, F.lit(0)), "p_eqtl": F.get(eqtl, F.lit(1)), "closest": last("closest gene"), "gene": last("gene"), "probe": last("probe set id")}
    detected = places["snp"].isNotNull() & (F.size(eqtl) >= 2) & places["disease"].isNotNull()

    def made() -> Column:
        here = tx.sanitize_topsnp(value_of("snp"))
        snp, closest = filled(F.when(has_rs(here), here).otherwise("")), filled(tx.sanitize_locus(value_of("closest")))
        gene, expressed = tx.sanitize_locus(value_of("gene")), F.col("g.expressed")
        beta, p = num.safe_float(value_of("beta")), F.when(expressed, num.safe_float(value_of("p_eqtl"))).otherwise(num.safe_float(value_of("disease")))
        notes = F.regexp_replace(F.concat(F.lit("Probe set: "), value_of("probe"), F.lit("; closest gene: "), closest), "^[; ]+|[; ]+$", "")
        either = lambda a, b: F.when(expressed, a).otherwise(b)
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), locus=F.when(gene != "", gene).otherwise(closest), gene=gene, notes=notes, confidence=F.lit(0.78), p=p, p_raw=p.cast("string"), p_note=either("eQTL association P-value", "AD association P-value"), effect_type=either("Beta", "NR"), effect=F.when(expressed, beta), effect_raw=either(beta.cast("string"), ""), grp=either("eQTL association", "AD association"), phenotype_derived=either("Expression", "AD"), plot=either("Beta", ""), keep=has_rs(snp) & p.isNotNull())

    return Layout(detected, places, fixed_structs(["expressed"], [(True,), (False,)]), made)


def expression_summary_layout() -> Layout:
    """Cells "p (beta)" of two expression summaries."""
    sums = places_of(holding("esnp association summary"))
    places = {"snp": last("eqtl"), "gene": last("gene"), "ea": last("ea"), "ra": last("ra"), "other": F.get(sums, F.lit(2)), "sum_0": F.get(sums, F.lit(0)), "sum_1": F.get(sums, F.lit(1))}

    def made() -> Column:
        snp, other, one = tx.sanitize_topsnp(value_of("snp")), value_of("other"), F.col("g.one")
        raw = F.when(one, value_of("sum_0")).otherwise(value_of("sum_1"))
        p, beta = num.p_of_pair(raw), num.beta_of_pair(raw)
        region = F.when(one, "Hippocampus").when(other != "", other).otherwise("Other brain region")
        return record(name=snp, top_snp=snp, kind=F.lit("SNP-based"), ra1=value_of("ea"), ra2=value_of("ra"), locus=tx.sanitize_locus(value_of("gene")), p=p, p_raw=p.cast("string"), effect_type=F.lit("Beta"), effect=beta, effect_raw=beta.cast("string"), grp=F.lit("eQTL"), phenotype=region, phenotype_derived=F.lit("Expression"), plot=F.lit("Beta"), notes=F.lit("eQTL comparison table"), confidence=F.lit(0.75), keep=has_rs(snp) & (p.isNotNull() | beta.isNotNull()))

    return Layout(places["snp"].isNotNull() & places["gene"].isNotNull() & (F.size(sums) >= 2), places, fixed_structs(["one"], [(True,), (False,)]), made)


LAYOUTS = (pipe_layout, two_block_layout, survival_layout, hazard_layout, inline_groups_layout, many_p_layout, combination_layout, joint_layout, expression_layout, expression_summary_layout)


def tiered(tier) -> Column:
    """The right-most place of the best tier of a header rule."""
    ranked = F.transform(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.struct((-tier(F.get("raw", i))).alias("t"), i.alias("i")))
    return F.array_max(F.filter(ranked, lambda x: x["t"].isNotNull()))["i"]


def ruled_places(heads: DataFrame, columns: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(table_id, raw, place of each role) by a table of rules; roles that no rule names have no place."""
    known = [*rules.ROLE_PATTERNS, *rules.RANKED_ROLES]
    nth = columns.withColumn("nth", F.row_number().over(Window.partitionBy("table_id").orderBy("col_idx")) - 1)
    found = headers.roles_by_rules(columns, rule_table).join(nth.select("table_id", "col_idx", "nth"), ["table_id", "col_idx"])
    places = found.groupBy("table_id").agg(*[F.max(F.when(F.col("role") == r, F.col("nth"))).cast("int").alias(f"at_{r}") for r in known])
    return heads.select("table_id", "raw").join(places, "table_id", "left")


def role_places(columns: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """(table_id, place of each role): one row per table, so rows need no header rule of their own. Roles follow a table of rules (headers.RULE) if one is given."""
    heads = headers_of(columns)
    if rule_table is not None:
        return with_kind(ruled_places(heads, columns, rule_table))
    role = {r: last(*words) for r, words in rules.ROLE_PATTERNS.items()}
    role |= {"a1": F.coalesce(last("a1"), last("allele 1")), "a2": F.coalesce(last("a2"), last("allele 2")), "p": tiered(headers.p_value_tier), "effect": tiered(headers.effect_tier)}
    role["variant"] = F.coalesce(F.try_element_at(places_of(lambda h: h == "variant"), F.lit(-1)), last("variant all", "location and base pair change", "chr:position"), last("variant"), last("location", "change"), role["rs"])
    placed = heads.select("table_id", "raw", *[c.cast("int").alias(f"at_{r}") for r, c in role.items()])
    return with_kind(placed)


def with_kind(placed: DataFrame) -> DataFrame:
    """Places with the kind of effect, and whether p-values are logarithms."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Beta", "OR", "Beta", "HR", "Zscore")]), F.coalesce(headers.effect_tier(F.get("raw", F.col("at_effect"))), F.lit(1)))
    p_head = F.coalesce(F.get("raw", F.col("at_p")), F.lit(""))
    return placed.select(*placed.drop("raw").columns, F.when(F.col("at_effect").isNull(), "NR").otherwise(kind).alias("effect_type"), num.is_neg_log(p_head).alias("converted"))


def subgroup_places(subgroups: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, groups): the places of each subgroup's metrics, one row per table."""
    nth = columns.withColumn("nth", F.row_number().over(Window.partitionBy("table_id").orderBy("col_idx")) - 1)
    found = subgroups.join(nth.groupBy("table_id", "name").agg(F.min("nth").cast("int").alias("nth")), ["table_id", "name"])
    of = lambda metric, value: F.max(F.when(F.col("metric") == metric, value))
    per = found.groupBy("table_id", "label").agg(*[of(m, F.col("nth")).alias(f"{m}_at") for m in ("snp", "p", "ci", "effect")], of("effect", headers.effect_type(F.col("name"))).alias("kind"), F.coalesce(of("p", num.is_neg_log("name")), F.lit(False)).alias("converted"))
    return per.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("label", "snp_at", "p_at", "ci_at", "effect_at", "kind", "converted"))).alias("groups"))


def generic(rows: DataFrame, columns: DataFrame, subgroups: DataFrame | None = None, rule_table: DataFrame | None = None) -> DataFrame:
    """Records of tables in no known layout: roles by header words, rows without content skipped, merged cells carried down, subgroups and rs ids exploded."""
    roles = role_places(columns, rule_table)
    names_of = [c[3:] for c in roles.columns if c.startswith("at_")]
    rows = rows.join(roles, "table_id")
    # each role's cell once, as a column of its own
    rows = rows.select("table_id", "row_idx", "raw", "heads", "vals", *roles.drop("table_id").columns, *[at(F.col(f"at_{r}")).alias(f"c_{r}") for r in names_of])
    role = {r: F.col(f"at_{r}") for r in names_of}
    cell_of = {r: F.col(f"c_{r}") for r in names_of}
    kind = F.col("effect_type")
    chrom, bp = num.chromosome_position(cell_of["chr"], cell_of["bp"])
    place_text = F.coalesce(*[F.when(cell_of[x] != "", cell_of[x]) for x in ("location", "variant", "bp", "chr")], F.lit(""))
    chrom2, bp2, ra1, ra2 = num.location_alleles(place_text)
    or_else = lambda a, b: F.when(a != "", a).otherwise(b)
    raw_effect, ci_cell = cell_of["effect"], cell_of["ci"]
    parsed_ci = num.interval_of(raw_effect, kind)
    a1a2 = num.alleles_and_frequency(cell_of["a1a2maf"])
    ea_oa, major_minor = num.first_second(cell_of["ea_oa"]), num.minor_major(cell_of["major_minor"])
    pick = lambda k, single: F.when(role["a1a2maf"].isNotNull(), a1a2[k]).when(role["ea_oa"].isNotNull(), ea_oa[k]).when(role["a1"].isNotNull() & role["a2"].isNotNull(), single).otherwise(major_minor[k])
    named = tx.rs_ids(cell_of["rs"])
    shown_rows = rows.select(
        "table_id", "row_idx", "raw", "vals", "effect_type", "converted", F.when(F.size(named) > 0, named).otherwise(tx.rs_ids(F.array_join("vals", " | "))).alias("ids"), tx.sanitize_topsnp(cell_of["rs"]).alias("rs_text"), tx.sanitize_topsnp(cell_of["variant"]).alias("variant"),
        tx.sanitize_locus(cell_of["locus"]).alias("locus"), or_else(chrom, chrom2).alias("chrom"), or_else(bp, bp2).alias("bp"), or_else(pick(0, cell_of["a1"]), ra1).alias("ra1"), or_else(pick(1, cell_of["a2"]), ra2).alias("ra2"),
        F.when(role["a1a2maf"].isNotNull() & (a1a2[2] != ""), a1a2[2]).otherwise(cell_of["maf"]).alias("maf"), *[cell_of[r].alias(r) for r in ("cohort", "imputation", "population", "sample_size")], cell_of["interaction"].alias("interactions"),
        F.when(F.col("converted"), F.pow(F.lit(10.0), -num.safe_float(cell_of["p"]))).otherwise(num.safe_float(cell_of["p"])).alias("p"), F.coalesce(num.effect_of(raw_effect), num.safe_float(raw_effect)).alias("own_effect"),
        F.when((parsed_ci != "") & ((ci_cell == "") | (role["ci"] == role["effect"])), parsed_ci).otherwise(ci_cell).alias("ci"),
    )
    shown_rows = shown_rows.withColumn("effect", F.coalesce("own_effect", F.when(kind.isin("OR", "HR"), num.effect_of("ci"))))
    section = (F.size("ids") == 0) & (F.size(F.array_distinct(F.filter("vals", lambda v: v != ""))) == 1) & (F.size(F.filter("vals", lambda v: v != "")) / F.size("vals") >= 0.6)
    nothing = (F.size("ids") == 0) & F.col("p").isNull() & F.col("effect").isNull()
    kept = shown_rows.where(~section & ~(nothing & (F.col("chrom") == "") & (F.col("bp") == "") & (F.col("locus") == "")))
    carried = kept.withColumns({c: filled(F.col(c)) for c in ("variant", "locus", "chrom", "bp", "ra1", "ra2", "maf", "cohort", "imputation", "population", "sample_size")})
    nothing_left = (F.size("ids") == 0) & F.col("p").isNull() & F.col("effect").isNull() & (F.col("chrom") == "") & (F.col("bp") == "")
    carried = carried.where(~nothing_left)
    plain = F.struct(F.lit("").alias("label"), F.lit("").alias("snp"), "p", "converted", "effect", "ci", "effect_type")
    if subgroups is None:
        subs = F.array(plain)
    else:
        carried = carried.join(subgroup_places(subgroups, columns), "table_id", "left")

        def sub(g: Column) -> Column:
            e_raw, c_raw = at(g["effect_at"]), at(g["ci_at"])
            e_kind = F.coalesce(g["kind"], F.col("effect_type"))
            c = F.when(c_raw != "", c_raw).otherwise(num.interval_of(e_raw, e_kind))
            e = F.coalesce(num.effect_of(e_raw), num.safe_float(e_raw), F.when(e_kind.isin("OR", "HR"), num.effect_of(c_raw)))
            p = num.safe_float(at(g["p_at"]))
            return F.struct(g["label"].alias("label"), at(g["snp_at"]).alias("snp"), F.when(g["converted"], F.pow(F.lit(10.0), -p)).otherwise(p).alias("p"), g["converted"].alias("converted"), e.alias("effect"), c.alias("ci"), e_kind.alias("effect_type"))

        own = F.filter(F.transform(F.coalesce("groups", F.expr("cast(array() as array<struct<label:string,snp_at:int,p_at:int,ci_at:int,effect_at:int,kind:string,converted:boolean>>)")), sub), lambda s: s["p"].isNotNull() | s["effect"].isNotNull())
        subs = F.when(F.size(own) > 0, own).otherwise(F.array(plain))
    # the subgroup's own ids, else the row's, else one record without an id
    exploded = carried.select("*", row_text().alias("row_text"), F.posexplode(subs).alias("sub_at", "sub"))
    none = F.array(F.lit("NR"))
    own_ids = tx.rs_ids(F.col("sub.snp"))
    names = F.when(F.size(own_ids) > 0, own_ids).when(F.size("ids") > 0, F.col("ids")).otherwise(none)
    # ids of a subgroup follow each other
    exploded = exploded.select("*", F.posexplode(names).alias("id_at", "id")).withColumn("sub_no", F.col("sub_at") * 1000 + F.col("id_at"))
    snp = tx.sanitize_topsnp(F.coalesce(*[F.when(c != "", c) for c in (F.col("sub.snp"), F.col("rs_text"), F.col("variant"))], F.when(F.col("id") != "NR", F.col("id")), F.lit("")))
    known = F.col("id") != "NR"
    r = record(
        name=F.when(known, F.col("id")).otherwise(snp), top_snp=snp, kind=F.when(known | F.lower(snp).startswith("rs"), "SNP-based").when(F.col("locus") != "", "Gene-based").otherwise(""), chrom=F.col("chrom"), bp=F.col("bp"), ra1=F.col("ra1"), ra2=F.col("ra2"), maf=F.col("maf"),
        effect_type=F.col("sub.effect_type"), effect=F.col("sub.effect"), effect_raw=F.col("sub.effect").cast("string"), ci=F.col("sub.ci"), p=F.col("sub.p"), p_raw=F.col("sub.p").cast("string"), p_note=F.when(F.col("sub.converted") & F.col("sub.p").isNotNull(), "Converted from -log10(p)").otherwise(""),
        grp=F.col("sub.label"), phenotype_derived=tx.strip(F.replace(F.element_at(F.split("sub.label", "\\("), -1), F.lit(")"), F.lit(""))), locus=F.col("locus"), cohort=F.col("cohort"), sample_size=F.col("sample_size"), population=F.col("population"), imputation=F.col("imputation"), interactions=F.col("interactions"),
        confidence=F.when(known, 0.55).otherwise(0.4), keep=F.lit(True),
    )
    return exploded.select("table_id", "row_idx", F.lit(len(LAYOUTS)).alias("layout"), "sub_no", r.alias("r"), "row_text")


def first_layout(candidates: DataFrame) -> DataFrame:
    """Candidates of the first layout that has any, per table."""
    least = F.min("layout").over(Window.partitionBy("table_id"))
    return candidates.withColumn("__least", least).where(F.col("layout") == F.col("__least")).drop("__least")


def headers_of(columns: DataFrame) -> DataFrame:
    """(table_id, raw, heads): one row per table."""
    heads = columns.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "name"))), lambda x: x["name"]).alias("raw"))
    return heads.withColumn("heads", F.transform("raw", lambda r: tx.normalize(r)))


def layouts_present(heads: DataFrame) -> list[int]:
    """Layouts that the headers of some table admit (whatever its first row); one flag each, from one row per table. Others need no branch in the plan."""
    admitted = heads.withColumn("first_vals", F.array(F.lit("apoe*4")))
    found = admitted.agg(*[F.coalesce(F.max(layout().detected), F.lit(False)).alias(f"l{k}") for k, layout in enumerate(LAYOUTS)]).first()
    return [k for k in range(len(LAYOUTS)) if found[k]]


def of_layout(rows: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(table_id, row_idx, layout, sub_no, r, row_text) of the tables of one layout."""
    layout = LAYOUTS[k]()
    if LAYOUTS[k] is inline_groups_layout:
        heads = heads.join(rows.groupBy("table_id").agg(F.min_by("vals", "row_idx").alias("first_vals"), F.min("row_idx").alias("first_idx")), "table_id")
    own = heads.where(layout.detected).select(*heads.columns, *[c.cast("int").alias(n) for n, c in layout.places.items()])
    each = layout.each if layout.each is not None else F.array(F.struct(F.lit(0).alias("only")))
    own = own.select("table_id", *layout.places, F.posexplode(each).alias("sub_no", "g"))
    return rows.select("table_id", "row_idx", "vals").join(own, "table_id").select("table_id", "row_idx", F.lit(k).alias("layout"), "sub_no", layout.record().alias("r"), row_text().alias("row_text")).where("r.keep")


def row_text() -> Column:
    """The row's filled cells."""
    return F.array_join(F.filter("vals", lambda v: v != ""), " | ")


def records(cells: DataFrame, columns: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """(table_id, row_idx, layout, sub_no, row_text, fields ...) of all tables; roles of tables in no known layout by rule_table (headers.RULE) if one is given."""
    rows = grid(cells, columns)
    heads = headers_of(columns)
    parts = [of_layout(rows, heads, k) for k in layouts_present(heads)]
    parts.append(generic(rows, columns, headers.subgroups(columns), rule_table))
    chosen = first_layout(reduce(DataFrame.unionByName, parts))
    return chosen.select("table_id", "row_idx", "layout", "sub_no", "row_text", "r.*").drop("keep")


def curated(found: DataFrame, paper: str = "PAPER") -> DataFrame:
    """Records in the fixed sheet of curated columns; columns no one fills are NR."""
    named = {v: k for k, v in FIELDS.items()}
    own = {"PaperIDX": F.lit(paper), "TableIDX": F.concat(F.lit("T"), F.lpad(F.col("table_id").cast("string"), 5, "0")), "TopSNP": tx.sanitize_topsnp("top_snp"), "Chr": tx.integer_like("chrom"), "BP(Position)": tx.integer_like("bp"), "LocusName": tx.sanitize_locus("locus")}
    return found.select(*[own.get(c, F.col(named[c]) if c in named else F.lit("NR")).alias(c) for c in rules.CURATED_COLUMNS])
