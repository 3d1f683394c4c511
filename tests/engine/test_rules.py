import itertools
import random

import pytest
from pyspark.sql import functions as F

from litgrid.operators import extract, headers
from litgrid.plans import rules

WORDS = ["p", "P-value", "pval", "P joint", "meta P", "P value all", "het P", "pF", "-log10(P)", "- log 10 (p)", "−log10(P)", "log_{10} p", "log(10) p", "p_x", "x_p", "beta", "β", "β G", "beta g x snp", "OR", "odds ratio", "HR", "Z score", "z", "SNP", "SNP (rs)", "rsID", "variant", "Variant all", "Chr:Position", "Chr", "BP", "location change", "A1", "A2", "A1/A2", "EA/OA", "Allele 1", "Nearest gene", "MAF", "95% CI", "cohort", "n=", "major/ minor alleles", "snp*x", "plain", ""]


def tables(seed, n):
    rng = random.Random(seed)
    return [(t, c, rng.choice(WORDS) + rng.choice(["", "", " | " + rng.choice(WORDS), "  2"])) for t in range(n) for c in range(rng.randrange(1, 9))]


def test_rules_as_a_table_give_the_roles_of_the_built_in_ones(spark):
    columns = spark.createDataFrame(tables(1, 400), "table_id int, col_idx int, name string")
    table = headers.role_rules(spark)
    known = [*rules.ROLE_PATTERNS, "p", "effect"]
    got = headers.roles_by_rules(columns, table).where(F.col("role").isin(known))
    want = headers.roles(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(str, extract.role_places(columns, table).select(*extract.role_places(columns).columns).collect())) == sorted(map(str, extract.role_places(columns).collect()))


def test_changed_rules_change_roles(spark):
    columns = spark.createDataFrame([(1, 0, "Kennung"), (1, 1, "Kennung b"), (1, 2, "P value"), (2, 0, "x")], "table_id int, col_idx int, name string")
    mine = spark.createDataFrame([("rs", 1, "kennung", None, "first"), ("p", 1, "p value", "adjusted", None)], headers.RULE)
    assert sorted(map(tuple, headers.roles_by_rules(columns, mine).collect())) == [(1, "p", 2, "P value"), (1, "rs", 0, "Kennung")]
    cells = spark.createDataFrame([(1, 1, 0, "rs7"), (1, 1, 1, "rs8"), (1, 1, 2, "0.5")], "table_id int, row_idx int, col_idx int, value string")
    one = extract.records(cells, columns, mine).select("name", "p").first()
    assert tuple(one) == ("rs7", 0.5)


@pytest.mark.parametrize("rule", [(None, 1, "x", None, "last"), ("rs", None, "x", None, "last"), ("rs", 1, None, None, "last"), ("rs", 1, "x", None, "middle")])
def test_faulty_rules_are_errors(spark, rule):
    columns = spark.createDataFrame([(1, 0, "x")], "table_id int, col_idx int, name string")
    with pytest.raises(ValueError, match="1 faulty"):
        headers.roles_by_rules(columns, spark.createDataFrame([rule], headers.RULE))


def test_no_rules_and_no_columns(spark):
    none = spark.createDataFrame([], "table_id int, col_idx int, name string")
    assert headers.roles_by_rules(none, headers.role_rules(spark)).count() == 0
    some = spark.createDataFrame(list(itertools.product([1], [0], ["x", None])), "table_id int, col_idx int, name string")
    assert headers.roles_by_rules(some, spark.createDataFrame([], headers.RULE)).count() == 0
