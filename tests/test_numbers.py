from cellset.functions.numbers import compact
from pyspark.sql import functions as F


def test_compact_rounds_exact_halves_to_even_and_others_by_their_exact_value(spark):
    values = [1 / 32768, 3 / 32768, 1234567890.5, 1234567891.5, 0.12345678905, 0.98765432125, 2.5, 1e-300, 123456789012.0, -1 / 32768, 1e16]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, 0.0, -0.0, float("nan"), None])], "i int, v double")
    got = [r.t for r in rows.select("i", compact(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == ["%.10g" % v for v in values] + ["0", "0", "NaN", "NaN"]
    assert got[0] == "3.051757812e-05"
