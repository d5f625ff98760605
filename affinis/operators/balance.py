"""Balanced training sets and repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.draws import draw_int, draw_key, draw_unit
from affinis.operators.relational import clean_rows, id_count
from affinis.operators.skew import salted_lookup

# --- fixed values: size of the largest institution and the usual sample size ---
LARGEST_ID_COUNT = 3_500_000
SAMPLES_PER_ID = 50
EXTRA_SAMPLES = 25


def scaled_probability(df: DataFrame, id_col: str, key: list[str], samples: int = SAMPLES_PER_ID,
                       seed: int = 20) -> DataFrame:
    """Add a random draw, the row's id count, and the draw scaled down for frequent ids."""
    counted = id_count(df, id_col, spread=key)
    scale = F.lit(1) - (F.col("id_count") - samples) / F.lit(LARGEST_ID_COUNT - samples)
    return (
        counted.withColumn("random_prob", draw_unit(seed, *key))
        .withColumn("scaled_count", scale)
        .withColumn("final_prob", F.col("random_prob") * F.col("scaled_count"))
    )


def random_rank(df: DataFrame, id_col: str, text_col: str, keep: int, seed: int = 20) -> DataFrame:
    """Number the rows of each id in random order and keep the first ``keep``.

    Spark ranks before the shuffle as well, so a task sends at most ``keep``
    rows per id however frequent the id is.
    """
    w = Window.partitionBy(id_col).orderBy(draw_key(seed, id_col, text_col), text_col)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def weighted_sample(df: DataFrame, id_col: str, weight_col: str, n: int, key: list[str], seed: int = 20) -> DataFrame:
    """``n`` rows of every id, drawn without replacement in proportion to their weight.

    Every row draws the time of an exponential clock that runs at its weight, and the ``n`` earliest
    stay: the next row is always drawn by the weights of those left. The draw hangs on
    the row's ``key``, so reruns agree, and as in ``random_rank`` a task sends at most ``n`` rows of an id.
    Rows whose weight is null, NaN, infinite or not above zero are never drawn.
    """
    weight = F.col(weight_col).cast("double")
    drawable = (weight > 0) & (weight < float("inf"))  # NaN is above infinity
    clock = -F.log(1 - draw_unit(seed, *key)) / weight
    w = Window.partitionBy(id_col).orderBy(clock, *key)
    return df.filter(drawable).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def _extra_copies(id_col: str, rn: Column, k: Column, n: int, seed: int) -> Column:
    """How many of the ``n - k`` draws with replacement land on row ``rn`` of ``k``."""
    draws = F.sequence(F.lit(1), F.lit(n) - k)
    return F.size(F.filter(draws, lambda i: F.pmod(draw_int(seed, F.col(id_col), i), k) + 1 == rn))


def balance_per_id(df: DataFrame, id_col: str, text_col: str, n: int = SAMPLES_PER_ID,
                   extra: int = EXTRA_SAMPLES, seed: int = 20, mode: str = "sample") -> DataFrame:
    """Ids with fewer than ``n`` rows are drawn up to ``n``; others keep at most ``n + extra``.

    One shuffle: rows are cut to ``n + extra`` per id before it, which leaves
    ids below ``n`` whole, so their size is known inside the same partition and
    extra copies are made in the row itself. ``mode='single'`` repeats one row
    of a small id instead of drawing over all its rows.
    """
    kept = random_rank(df.select(id_col, text_col), id_col, text_col, n + extra, seed)
    k = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    counted = kept.withColumn("_k", k)
    small = F.col("_k") < n
    if mode == "single":
        counted = counted.filter(~small | (F.col("rn") == 1))
        copies = F.when(small, F.lit(n)).otherwise(1)
    else:
        copies = F.when(small, 1 + _extra_copies(id_col, F.col("rn"), F.col("_k"), n, seed)).otherwise(1)
    return (
        counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select(text_col, id_col, "copy_no")
    )


def upsample_replace(df: DataFrame, id_col: str, text_col: str, n: int, seed: int = 20) -> DataFrame:
    """Only the ids with fewer than ``n`` rows, drawn with replacement up to ``n`` rows."""
    kept = random_rank(df.select(id_col, text_col), id_col, text_col, n, seed)
    k = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    small = kept.withColumn("_k", k).filter(F.col("_k") < n)
    copies = 1 + _extra_copies(id_col, F.col("rn"), F.col("_k"), n, seed)
    return (
        small.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select(text_col, id_col, "copy_no")
    )


def balanced_training_set(history: DataFrame, synthetic: DataFrame, n: int = SAMPLES_PER_ID,
                          extra: int = EXTRA_SAMPLES, seed: int = 20, mode: str = "sample",
                          text_col: str = "original_affiliation", id_col: str = "affiliation_id") -> DataFrame:
    """Clean and dedupe history, keep ids with synthetic strings, add those, balance per id."""
    cleaned = clean_rows(history.select(text_col, id_col), text_col)
    ids = synthetic.select(id_col).distinct()
    known = salted_lookup(cleaned, ids, id_col, "left_semi")
    # one distinct over the union dedupes history too
    pool = (
        known.select(text_col, id_col)
        .union(synthetic.select(text_col, id_col))
        .filter(F.col(id_col).isNotNull())
        .distinct()
    )
    return balance_per_id(pool, id_col, text_col, n, extra, seed, mode)


def random_n(df: DataFrame, n: int, key: list[str], seed: int = 1) -> DataFrame:
    """``n`` random rows: each task keeps its own ``n`` smallest draws."""
    return df.orderBy(draw_key(seed, *key), *key).limit(n)


def train_val_split(df: DataFrame, key: list[str], train_fraction: float = 0.985, seed: int = 1) -> DataFrame:
    """Mark each row ``train`` or ``val`` from its own key; no shuffle, stable under retries."""
    return df.withColumn("split", F.when(draw_unit(seed, *key) < train_fraction, "train").otherwise("val"))
