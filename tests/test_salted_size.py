"""Copies of a dimension count for Spark's choice of a broadcast."""

import pytest
from pyspark.sql import functions as F

from affinis.operators.skew import salted_lookup


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_dimension_whose_copies_pass_the_limit_is_not_broadcast(spark, capsys):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        facts = spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("fact"))
        large, small = (spark.range(n).select(F.col("id").alias("key")) for n in (100_000, 1_000))
        for how in ("left", "left_semi"):
            assert "BroadcastHashJoin" not in plan_of(salted_lookup(facts, large, "key", how), capsys)  # 0.8 MB, 32 times
            assert "BroadcastHashJoin" in plan_of(salted_lookup(facts, small, "key", how), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("salts", [1, 5, 8, 30, 32])
def test_every_fact_finds_its_row_once(spark, salts):
    facts = spark.createDataFrame([(k, n) for k in (1, 2, 3, None) for n in range(100)], "key long, fact long")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "key long, name string")
    got = sorted(map(tuple, salted_lookup(facts, dim, "key", "left", ["fact"], salts).select("key", "fact", "name").collect()), key=str)
    assert got == sorted([(k, n, {1: "a", 2: "b"}.get(k)) for k in (1, 2, 3, None) for n in range(100)], key=str)
    assert salted_lookup(facts, dim.select("key"), "key", "left_semi", ["fact"], salts).count() == 200
