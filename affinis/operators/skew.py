"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 100_000
SALTS = 32
# Spark takes a row of a range for 8 bytes, and 8 copies of a row for one: joined to a range, copies count as what they are.
COUNTED_COPIES = 8
# Rows and characters of a dimension that every executor may hold.
BROADCAST_ROWS = 500_000
BROADCAST_CHARACTERS = 200 << 20


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """All keys with ``min_rows`` rows or more; there is one for every ``min_rows`` rows at most.

    Counting is pre-aggregated in the scan tasks. Spark broadcasts the result where
    it finds it small enough.
    """
    return df.groupBy(*keys).count().filter(F.col("count") >= min_rows).select(*keys)


def _salt(spread: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    salts: int = SALTS,
    min_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Equi-join whose hot left keys (and null keys) are split over ``salts`` tasks.

    Only the hot keys of the right side are copied, once per salt. ``spread``
    names columns that tell left rows of one key apart (default: all columns).
    """
    hot = hot_keys(left, keys, min_rows).withColumn("_hot", F.lit(True))
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_hot") | any_null, _salt(spread or left.columns, salts)).otherwise(0))
        .drop("_hot")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    spread: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Attach attributes of a dimension (one row per key) to a large table.

    Every dimension row is copied once per salt, so no counting pass over the
    facts is needed. When Spark finds the dimension small enough it broadcasts
    it by its own size check and no fact row moves. That check has to see all
    copies, or a broadcast has ``salts`` times the size that it was let pass for.
    """
    groups = -(-salts // COUNTED_COPIES)
    copied = dim.crossJoin(dim.sparkSession.range(groups).withColumnRenamed("id", "_salts"))
    salts_of = F.sequence(F.col("_salts").cast("int"), F.lit(salts - 1), F.lit(groups))
    salted_dim = copied.withColumn("_salt", F.explode(salts_of)).drop("_salts")
    salted_facts = facts.withColumn("_salt", _salt(spread or facts.columns, salts))
    return salted_facts.join(salted_dim, [key, "_salt"], how).drop("_salt")


def fits_in_tasks(dim: DataFrame) -> bool:
    """Whether a dimension has at most ``BROADCAST_ROWS`` rows, no more than one above being counted, and ``BROADCAST_CHARACTERS`` as JSON."""
    few = dim.limit(BROADCAST_ROWS + 1).select(F.length(F.to_json(F.struct(*[F.col(c) for c in dim.columns]))).alias("size"))
    rows, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_CHARACTERS


def bounded_lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    spread: list[str] | None = None,
) -> DataFrame:
    """``salted_lookup`` whose dimension is broadcast, in one copy, where it is small (``fits_in_tasks``).

    Spark's size check multiplies the sizes of joined tables, so a small dimension that is itself a join passes for
    a large one, and all facts are moved with its attributes. A bounded count decides here instead.
    """
    return facts.join(F.broadcast(dim), key, how) if fits_in_tasks(dim) else salted_lookup(facts, dim, key, how, spread)
