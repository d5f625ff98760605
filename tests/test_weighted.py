"""Weighted sampling without replacement: shares, repeatability and rows that cannot be drawn."""

from collections import Counter

from pyspark.sql import functions as F

from affinis.operators import balance

WEIGHTS = {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}


def test_shares(spark):
    """One row of four per group: drawn as often as its share of the weight says."""
    groups = 8000
    rows = spark.range(groups * 4).select((F.col("id") / 4).cast("long").alias("g"), (F.col("id") % 4).cast("int").alias("i"))
    rows = rows.withColumn("w", F.col("i") + 1.0)
    first, again = (balance.weighted_sample(df, "g", "w", 1, ["g", "i"]) for df in (rows, rows.repartition(7, "i")))
    drawn = Counter(r.i for r in first.collect())
    assert sum(drawn.values()) == groups and first.exceptAll(again).count() == 0
    # four standard errors
    assert all(abs(drawn[i] / groups - w / 10) < 4 * (w / 10 * (1 - w / 10) / groups) ** 0.5 for i, w in WEIGHTS.items())
    # the second of two draws follows the weights of those left
    pairs = balance.weighted_sample(rows, "g", "w", 2, ["g", "i"]).collect()
    both = Counter((r["rn"], r.i) for r in pairs)
    second = {i: sum(v / 10 * w / (10 - v) for j, v in WEIGHTS.items() if j != i) for i, w in WEIGHTS.items()}
    assert all(abs(both[2, i] / groups - p) < 4 * (p * (1 - p) / groups) ** 0.5 for i, p in second.items())


def test_undrawable_rows_and_whole_groups(spark):
    rows = [(1, i, w) for i, w in enumerate([1.0, None, 0.0, -1.0, float("nan"), float("inf"), 2.0])] + [(None, 9, 1.0)]
    found = balance.weighted_sample(spark.createDataFrame(rows, "g long, i long, w double"), "g", "w", 5, ["g", "i"]).collect()
    assert {(r.g, r.i) for r in found} == {(1, 0), (1, 6), (None, 9)}
    empty = spark.createDataFrame([], "g long, i long, w double")
    assert balance.weighted_sample(empty, "g", "w", 5, ["g", "i"]).collect() == []
