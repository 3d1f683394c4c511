"""The pipeline's stages, each on its own input, against brute-force versions."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute
from test_mixing_sharding import words
from test_text_operators import hits, rule_counts


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, rows[40][1]), (2, rows[-9][1])], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_each_stage(spark, docs, rows, folder):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]
    keys = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    kept = stage["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= sum(not rule_counts(r[1])[5] for r in rows)
    one = stage["jaccard_join"](spark, docs, folder)
    components = brute(rows, 5, 80)
    ids = {c for _, n, c in components if n and c is not None} | {i for i, n, _ in components if not n and i is not None}
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.where("doc_id is not null").collect()) == sorted(ids)
    items = [(1, rows[40][1]), (2, rows[-9][1])]
    clean = [r for r, h in zip(rows, hits([r[1] for r in rows], items, 10), strict=True) if not h[4]]
    assert keys(stage["decontamination"](spark, docs, folder)) == sorted(str((r[0], r[1])) for r in clean)
    mixed = stage["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    total = sum(words(r[1]) for r in rows)
    assert abs(sum(words(r["text"]) for r in mixed.collect()) - 1.5 * total) < 4 * max(words(r[1]) for r in rows)
    sharded = stage["sharding"](spark, docs, folder)
    assert keys(sharded) == sorted(str((r[0], r[1])) for r in rows)


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, folder)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)


def test_stages_of_an_empty_table(spark, empty, folder):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, folder).collect() == []
