"""Publication ranking: keyword profile and relevance score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions.text import normalize
from litgrid.operators.context import contains_any
from litgrid.plans import rules


def profile(records: DataFrame, column: str, order: str, least: int = 2) -> DataFrame:
    """(term, n): terms of a list column in at least so many places, most frequent first, then first seen."""
    terms = records.select(F.col(order).alias("seen"), F.posexplode(F.transform(column, normalize)).alias("place", "term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("seen", "place")).alias("first"))
    return counted.where((F.col("n") >= least) & (F.col("term") != "")).orderBy(F.desc("n"), "first").select("term", "n")


def as_array(terms: DataFrame) -> DataFrame:
    """A profile as one row with an array; profiles are short (terms of a few dozen seed papers)."""
    return terms.agg(F.sort_array(F.collect_list("term")).alias("terms"))


def relevance(title: Column, abstract: Column, types: Column, mesh: Column, profile_mesh: Column | None = None, profile_types: Column | None = None, words: dict | None = None) -> tuple[Column, Column]:
    """(score, reason)."""
    w = {"stop": rules.STOP_TYPES, "mesh": rules.POSITIVE_MESH, "topic": rules.TOPIC_HINTS, "genetics": rules.GENETICS_HINTS, "title": rules.TITLE_HINTS} | (words or {})
    t, a = normalize(title), normalize(abstract)
    both = F.concat(t, F.lit("\n"), a)
    ts, ms = F.transform(types, normalize), F.transform(mesh, normalize)
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    parts = [
        (F.arrays_overlap(ts, listed(w["stop"])), F.lit(-4), F.lit("excluded publication type")),
        (F.arrays_overlap(ms, listed(w["mesh"])), F.lit(4), F.lit("AD-related MeSH")),
        (contains_any(both, w["topic"]), F.lit(3), F.lit("AD keyword in title/abstract")),
        (contains_any(both, w["genetics"]), F.lit(2), F.lit("genetics keyword in title/abstract")),
        (contains_any(t, w["title"]), F.lit(2), F.lit("genetics keyword in title")),
    ]
    if profile_mesh is not None:
        shared = F.array_sort(F.array_intersect(F.array_distinct(ms), profile_mesh))
        parts.append((F.size(shared) > 0, F.least(F.lit(3), F.size(shared)), F.concat(F.lit("profile mesh overlap: "), F.array_join(F.slice(shared, 1, 3), ", "))))
    if profile_types is not None:
        shared_types = F.array_sort(F.array_intersect(F.array_distinct(ts), profile_types))
        parts.append((F.size(shared_types) > 0, F.lit(1), F.concat(F.lit("profile publication type overlap: "), F.array_join(F.slice(shared_types, 1, 3), ", "))))
    score = sum((F.when(F.coalesce(hit, F.lit(False)), points).otherwise(0) for hit, points, _ in parts), F.lit(0))
    reason = F.concat_ws(" | ", *[F.when(F.coalesce(hit, F.lit(False)), why) for hit, _, why in parts])
    return score, reason


def ranked(scored: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Relevance flag, and rows by score and then by key as text, both falling."""
    return scored.withColumn("relevant", F.col("score") >= least).orderBy(F.desc("score"), F.desc(F.col(key).cast("string")))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("hits"), F.count_if("relevant").alias("relevant_hits"))


def default_query(year: int | None = None) -> str:
    """A boolean literature query: topic and genetics terms without reviews, and a year if given."""
    # The parts of the published query.
    parts = [
        '(("Alzheimer Disease"[MeSH Terms]) OR (alzheimer*[Title/Abstract]))',
        '("gene"[Title] OR "genes"[Title] OR "genetics"[Title] OR "genetic*"[Title/Abstract])',
        "NOT (Review[Publication Type])",
    ]
    return " AND ".join(parts if year is None else [*parts, f'("{year}"[Date - Publication])'])
