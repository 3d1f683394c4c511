"""A page is parsed once for all rules of the choice of its table."""

from litgrid.plans import more_oracles, more_queries
from litgrid.sources import elements


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>")], "page_id int, html string")
    chosen = elements.article_tables(pages, spark.createDataFrame([(1, "T1")], "page_id int, table_id string"))
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in chosen.collect()] == [(1, "T1", 0, "place")]


def test_query_equals_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(more_oracles.SQL["article_tables"]).fetchall()
    assert sorted(map(tuple, more_queries.article_tables(spark, sf_dir).collect())) == sorted(want)
