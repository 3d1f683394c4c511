"""Rows without partner, with one key that has most rows; sources that fail; bulk actions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from litgrid.operators import align, enrich
from litgrid.sources import sheets

KEYS = ["snp", "chr", "p", "ra1"]
SCHEMA = "n bigint, snp string, chr string, p double, ra1 string"


def sides(rng):
    row = lambda i: (i, rng.choice(["rs1", "rs2", "rs3", None]), rng.choice(["1", "2", None]), rng.choice([0.1, 0.2, None]), rng.choice(["A", None]))
    hot = lambda i: (i, "rs9", "1", 0.5, None)
    pred = [row(i) if rng.random() < 0.3 else hot(i) for i in range(3000)]
    gold = [row(i) if rng.random() < 0.5 else hot(i) for i in range(1500)]
    return pred + [(6000, "rs3", "9", 0.2, "A")], gold + [(5000, "rs3", "7", 0.2, "A")]


def plain(pred, gold):
    key = lambda r: r[1:]
    hollow = lambda r: r[3] is None  # a missing number equals nothing
    left, out = Counter(key(r) for r in gold if not hollow(r)), []
    for r in sorted(pred):
        if not hollow(r) and left[key(r)]:
            left[key(r)] -= 1
            continue
        same = [g for g in gold if g[1] == r[1] and r[1] is not None]
        wrong = [f"{k}_mismatch" for i, k in enumerate(KEYS) if i and not any(g[i + 1] == r[i + 1] and not (k == "p" and g[i + 1] is None) for g in same)]
        out.append((r[0], "snp_not_in_gold" if not same else "|".join(wrong) or "key_mismatch"))
    left = Counter(key(r) for r in pred if not hollow(r))
    for r in sorted(gold):
        if not hollow(r) and left[key(r)]:
            left[key(r)] -= 1
        else:
            out.append((r[0], "missing_in_prediction"))
    return sorted(out)


def test_diagnosis_equals_pairing_off_in_order(spark):
    pred, gold = sides(random.Random(2))
    p, g = spark.createDataFrame(pred, SCHEMA).repartition(5), spark.createDataFrame(gold, SCHEMA).repartition(4)
    got = sorted((r["n"], r["reason"]) for r in align.diagnose(p, g, KEYS, "n").collect())
    assert got == plain(pred, gold)
    assert {x.split("|")[0] for _, x in got} >= {"snp_not_in_gold", "key_mismatch", "missing_in_prediction", "chr_mismatch"}
    assert align.diagnose(p, g.limit(0), KEYS, "n").select("reason").distinct().collect()[0][0] == "snp_not_in_gold"
    assert align.unmatched(p.limit(0), g, KEYS, "n").count() == 0
    info = align.diagnose(p, None, KEYS, "n")
    assert [(r["type"], r["reason"], r["snp"]) for r in info.collect()] == [("info", "pmid_not_in_gold", None)] and info.columns == ["type", "reason", *p.columns]


def test_a_hot_key_is_dealt_into_parts(spark):
    rows = spark.range(100_000).select(F.col("id").alias("n"), F.lit("rs9").alias("snp"), F.lit("1").alias("chr"), F.lit(0.5).alias("p"), F.lit(None).cast("string").alias("ra1"))
    dealt = align.dealt_by_order(rows, "n")
    sizes = [r["count"] for r in dealt.groupBy(*KEYS, "__part").count().collect()]
    assert len(sizes) == align.DEALT and max(sizes) < 3 * 100_000 / align.DEALT
    left = align.unmatched(rows, rows.where("n < 70000"), KEYS, "n")
    assert (left.count(), left.agg(F.min("n")).first()[0]) == (30_000, 70_000)
    over = align.bag_except(rows, rows.where("n < 40000"), KEYS)
    assert (over.count(), over.select("copy").distinct().count()) == (60_000, 60_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one task
    assert over.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sources_that_fail_are_listed_and_the_others_read(spark, tmp_path):
    sheets.write_workbook(str(tmp_path / "1_table1.xlsx"), {"s": (spark.createDataFrame([("rs1", "0.5")], "snp string, p string"), [])})
    (tmp_path / "2_table1.xlsx").write_bytes(b"no archive")
    (tmp_path / "3_table1.csv").write_text("a,b\n1,2\n")
    sources = [str(tmp_path / n) for n in ("1_table1.xlsx", "2_table1.xlsx", "3_table1.csv", "4.pdf", "gone.csv")]
    cells, errors = sheets.readable_tables(spark, sources)
    assert {r["path"].rsplit("/", 1)[-1] for r in cells.select("path").distinct().collect()} == {"1_table1.xlsx", "3_table1.csv"}
    assert cells.where("value = 'rs1'").count() == 1
    found = {r["source"].rsplit("/", 1)[-1]: r["error"] for r in errors.collect()}
    assert set(found) == {"2_table1.xlsx", "4.pdf", "gone.csv"} and "BadZipFile" in found["2_table1.xlsx"] and found["gone.csv"] == "PATH_NOT_FOUND"
    none, all_failed = sheets.readable_tables(spark, [str(tmp_path / "x.doc")])
    assert none.count() == 0 and all_failed.count() == 1


def test_bulk_actions_move_to_known_statuses_only(spark):
    entries = spark.createDataFrame([("1", "new", "t0"), (" 2 ", "new", "t0"), ("3", "complete", None)], "pmid string, status string, updated_at string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "pmid string")
    state = lambda df: sorted((r["pmid"].strip(), r["status"], r["updated_at"]) for r in df.collect())
    before = state(entries)
    assert state(enrich.bulk_action(entries, keys("1"), "pmid", "move", "done")) == before
    assert state(enrich.bulk_action(entries, keys("1"), "pmid", "archive", "new")) == before
    assert state(enrich.bulk_action(entries, keys("", "  "), "pmid", "delete")) == before
    assert state(enrich.bulk_action(entries, keys(" 1", "2"), "pmid", "move", "in_progress", "now")) == [("1", "in_progress", "now"), ("2", "in_progress", "now"), ("3", "complete", None)]
    assert state(enrich.bulk_action(entries, keys("3"), "pmid", "delete")) == before[:2]
    stamped = enrich.bulk_action(entries.drop("updated_at"), keys("3"), "pmid", "move", "new").where("updated_at is not null").collect()
    assert len(stamped) == 1 and len(stamped[0]["updated_at"]) == 19
