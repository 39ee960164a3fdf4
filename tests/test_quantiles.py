import random

import numpy as np
from pyspark.sql import functions as F

from scrollmill.operators.quantiles import quantiles


def test_against_numpy_with_ties_nulls_and_narrow_ranges(spark):
    rng = random.Random(5)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 500 + [8.0] * 499, "narrow": [1e9 + i * 1e-3 for i in range(3000)],
        "wide": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(3000)], "hot": [0.0] * 4000 + [rng.random() for _ in range(2000)], None: [-1.0, 4.0, 9.5],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"low": 0.0, "median": 0.5, "p90": 0.9, "high": 1.0}
    for slices in (2, 256):
        got = {r.g: r for r in quantiles(df, ["g"], "v", wanted, slices).collect()}
        assert set(got) == {*groups, "none"}
        for g, vs in groups.items():
            assert np.allclose([got[g][n] for n in wanted], np.quantile(vs, list(wanted.values())), rtol=1e-12, atol=0), g
        assert [got["none"][n] for n in wanted] == [None] * 4


def test_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles(empty, ["g"], "v", {"median": 0.5}).count() == 0
    assert quantiles(empty.withColumn("v", F.lit(1.0)), ["g"], "v", {"median": 0.5}).columns == ["g", "median"]
