"""The automaton, snippets and the mention index against plain scans."""

import random
import re
import time

from pyspark.sql import functions as F

from litgrid.operators import context, mentions
from litgrid.plans import rules


def plain_snippets(text, words, window, most):
    out, low = {}, text.lower()
    for w in words:
        for m in re.finditer(re.escape(w.lower()), low):
            cut = text[max(0, m.start() - window) : m.end() + window].replace("\n", " ")
            out.setdefault(cut[:200], cut)
    return list(out.values())[:most]


def noise(rng, n, words):
    return "".join(rng.choice([*words, *words, "x", " ", "\n", "a ", "_", "9", "é"]) for _ in range(n))


def test_mentions_and_snippets_equal_plain_scans(spark):
    rng = random.Random(4)
    words = ["aa", "a a", "aaa", "HRC", "hrc panel", "é", "panel"]
    texts = [noise(rng, rng.randrange(60), words) for _ in range(200)] + ["", None, "aaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", mentions.mentions(F.lower("t"), words).alias("m"), mentions.snippets(F.col("t"), words, 5, 4).alias("s")).collect()
    for r in got:
        t = texts[r["i"]]
        low = (t or "").lower()
        want = {k: [m.start() for m in re.finditer(re.escape(w.lower()), low)] for k, w in enumerate(words)}
        held = [k for k in want if want[k]]
        assert (r["m"]["words"], r["m"]["firsts"], r["m"]["counts"]) == (held, [want[k][0] for k in held], [len(want[k]) for k in held])
        free = lambda k, b: not re.match(r"\w", low[b - 1 : b]) and not re.match(r"\w", low[b + len(words[k]) : b + len(words[k]) + 1])
        assert r["m"]["whole"] == [k for k in held if any(free(k, b) for b in want[k])]
        assert r["s"] == (None if t is None else plain_snippets(t, words, 5, 4))


def test_very_many_mentions_take_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("hrc, table 1; adni "), 300_000).alias("text"), F.col("id").alias("paper_id"))
    began = time.time()
    r = df.select(mentions.mentions(F.lower("text"), ["hrc", "adni"]).alias("m"), F.size(mentions.snippets(F.col("text"), ["adni", "hrc"])).alias("n")).first()
    assert r["m"]["counts"] == [300_000, 300_000] and r["n"] == 3  # few differ
    n = {x["word"]: x["n"] for x in mentions.within(mentions.index(df, "paper_id", "text", ["hrc", "adni"]), "paper_id").collect()}
    assert set(n) == {0, 1} and min(n.values()) > 100
    assert time.time() - began < 150  # a quadratic scan would take hours


def plain_cohorts(own, body, place, synonyms):
    """The rule on one record: words near the table's mentions, all text searched anew."""
    flat = lambda t: " ".join((t or "").split()).lower()
    own, body = flat(own), body or ""
    row = list(dict.fromkeys(v for k, v in synonyms.items() if k in own))
    near = [flat(x) for x in plain_snippets(body, [flat(place)], 1200, 8)] if flat(place) else []
    counts = {}
    for k, v in synonyms.items():
        counts[v] = counts.get(v, 0) + sum(x.count(k) for x in near)
    named = [v for v in dict.fromkeys(synonyms.values()) if counts[v]]
    best = sorted(named, key=lambda v: (-counts[v], list(counts).index(v)))
    if len(best) > 1 and counts[best[0]] >= max(2, counts[best[1]] + 1):
        named = best[:1]
    whole = list(dict.fromkeys(v for k, v in synonyms.items() if k in flat(body) and k not in own))
    hits = row or named or whole
    also = ["ADNI"] * ("eqtl" in own) + ["IGAP"] * ("ad association" in own or "disease association" in own)
    return ";".join(dict.fromkeys(hits + also)) or "NR"


def test_record_cohorts_equal_a_plain_search(spark):
    rng = random.Random(9)
    synonyms = rules.COHORT_SYNONYMS
    names = [*synonyms, "Table 1", "Table 12", "table 2", "TABLE 3", "zzz " * 150, "yy " * 400, "health and\nretirement  study"]
    papers = [(p, " , ".join(rng.choice(names) for _ in range(rng.randrange(40))) if p % 9 else rng.choice([None, ""])) for p in range(60)]
    body = dict(papers)
    rows = [(i, rng.randrange(62), rng.choice(["", None, "of ADGC", "eQTL", "an AD association", "adni of igap", "x"]), rng.choice(["Table 1", "Table  2", "table 12", "Table 3", "Table 9", "", None])) for i in range(400)]
    rows += [(1000 + i, 7, "", "Table 1") for i in range(300)]  # one paper with many records
    records = spark.createDataFrame(rows, "i int, p int, own string, tab string")
    got = context.record_cohorts(records, "own", "tab", spark.createDataFrame(papers, "p int, text string"), "p").collect()
    assert len(got) == len(rows)
    found = {r["i"]: r["cohort_found"]["value"] for r in got}
    want = {i: plain_cohorts(own, body.get(p), tab, synonyms) for i, p, own, tab in rows}
    assert found == want
    assert len(set(want.values())) > 20


def test_no_text_in_a_shuffle(spark):
    papers = spark.createDataFrame([(1, "x")], "paper_id int, text string")
    records = spark.createDataFrame([(1, "r", "Table 1")], "paper_id int, said string, place string")
    plan = context.record_cohorts(records, "said", "place", papers)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") and not re.search(r"Exchange[^\n]*\n[^\n]*(Project|Scan)[^\n]*text", plan)
    found = context.paper_context(papers, "paper_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in found
