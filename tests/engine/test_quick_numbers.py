import math
import time

from pyspark.sql import functions as F

from litgrid.functions import numbers as num


def test_texts_that_are_no_numbers_are_none(spark):
    texts = {"5.": 5.0, "-.5": -0.5, "+5.e-3": 0.005, "1_000": 1000.0, "inf": math.inf, "-Infinity": -math.inf, "6 e-3": None, "rs11": None, "1e5.": None, ".": None, "-": None, "1d": None, "0x1": None, "٣": None, "nan": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", num.safe_float("t").alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts


def test_texts_that_are_no_numbers_cost_less_than_a_failed_cast(spark):
    df = spark.range(0, 300_000, 1, 1).select(F.concat(F.lit("rs"), F.col("id")).alias("t"))

    def seconds(c):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            df.select(F.xxhash64(c).alias("h")).agg(F.bit_xor("h")).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(num._whole(F.col("t"))) < seconds(F.col("t").try_cast("double"))
