"""Row filters, dedupe, joins on ids and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.skew import salted_lookup, skew_join


# ---------------------------------------------------------------- filters --
def filter_has_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.filter(F.col(id_col) != "")


def clean_rows(df: DataFrame, text_col: str, min_len: int = 2) -> DataFrame:
    """Trim blanks, then keep texts longer than ``min_len``."""
    trimmed = df.withColumn(text_col, F.trim(text_col))
    return trimmed.filter(F.col(text_col).isNotNull() & (F.length(text_col) > min_len))


def as_text(c: Column) -> Column:
    """Any value as text; a missing value becomes the word ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def filter_min_len(df: DataFrame, col: str, min_len: int = 2) -> DataFrame:
    out = df.withColumn(col, as_text(F.col(col)))
    return out.filter(F.length(col) > min_len)


def filter_max_len(df: DataFrame, col: str, below: int = 500) -> DataFrame:
    return df.filter(F.length(col) < below)


def filter_in_set(df: DataFrame, col: str, values: Iterable, keep: bool = True) -> DataFrame:
    test = F.col(col).isin(*values)
    return df.filter(test if keep else ~test)


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def relabel_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[col])


def fill_missing_ids(c: Column) -> Column:
    """An id list, or ``[-1]`` where there is none."""
    return F.coalesce(c, F.array(F.lit(-1).cast("bigint")))


# ----------------------------------------------------------------- dedupe --
def dedupe_count(df: DataFrame, text_col: str, id_col: str, out: str = "n") -> DataFrame:
    return df.groupBy(text_col, id_col).agg(F.count(id_col).alias(out))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in a total order.

    The rank filter is applied before the shuffle too, so each task sends at
    most one row per key and a key with very many copies stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedupe_pick(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Smallest id per key: a map-side combined hash aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col))


# ------------------------------------------------------------------ joins --
def join_known_ids(history: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Distinct history rows whose id occurs in ``known``.

    The id list is one row per institution. Spark broadcasts it where its size
    allows; otherwise the rows of a frequent id are split by salt.
    """
    ids = known.select(id_col).distinct()
    return salted_lookup(history, ids, id_col, "left_semi").distinct()


def join_registry(registry: DataFrame, institutions: DataFrame, key: str) -> DataFrame:
    return registry.join(institutions, key, "inner")


def join_left_names(registry: DataFrame, institutions: DataFrame, key: str) -> DataFrame:
    """Every registry row with all its institution rows; unmatched rows stay."""
    return registry.join(institutions, key, "left")


def join_back_predictions(rows: DataFrame, predictions: DataFrame, text_col: str, pred_col: str,
                          row_id: str) -> DataFrame:
    """Give every input row the prediction of its text, ``[-1]`` where there is none."""
    out = skew_join(rows, predictions, [text_col], "left", spread=[row_id])
    return out.withColumn(pred_col, fill_missing_ids(F.col(pred_col)))


def join_shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on every column both tables have."""
    return left.join(right, [c for c in left.columns if c in right.columns], "inner")


def lookup_institution(facts: DataFrame, institutions: DataFrame, key: str = "inst_id",
                       spread: list[str] | None = None) -> DataFrame:
    return salted_lookup(facts, institutions, key, "left", spread)


def remap_merged(df: DataFrame, merged: DataFrame, id_col: str, distinct: bool = False,
                 spread: list[str] | None = None) -> DataFrame:
    """Replace merged ids by their successor, keep all others."""
    names = merged.select(F.col("old_id").alias(id_col), F.col("new_id"))
    out = salted_lookup(df, names, id_col, "left", spread)
    out = out.withColumn(id_col, F.coalesce("new_id", id_col)).drop("new_id").select(*df.columns)
    return out.distinct() if distinct else out


def lookup_successor_names(ids: DataFrame, successors: DataFrame, old_names: DataFrame) -> DataFrame:
    """Per institution the distinct names of all institutions it replaced.

    ``ids(registry_id)``, ``successors(registry_id, old_id)``, ``old_names(old_id, name)``.
    """
    found = ids.join(successors, "registry_id", "left").join(old_names, "old_id", "left")
    return found.groupBy("registry_id").agg(F.array_sort(F.collect_set("name")).alias("extra_names"))


# ------------------------------------------------------------ aggregation --
def common_name_ids(rows: DataFrame, name_cols: Sequence[str], id_col: str) -> DataFrame:
    """Ids of all rows whose name occurs more than once."""
    shared = rows.groupBy(*name_cols).count().filter("count > 1").drop("count")
    return skew_join(rows, shared, list(name_cols), "left_semi", spread=[id_col]).select(id_col)


def group_list(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """Sorted list of values per key (the relation of a successor to its few predecessors)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))


def id_count(df: DataFrame, id_col: str, spread: list[str] | None = None) -> DataFrame:
    """Number of rows per id on every row.

    Counts are aggregated map-side and joined back; a window over the id would
    pull all rows of a frequent id into one task.
    """
    counts = df.groupBy(id_col).agg(F.count(id_col).alias("id_count"))
    return skew_join(df, counts, [id_col], "left", spread)


def first_candidate(df: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``value`` of the first row of every key in the order given; combined map-side, no window."""
    return df.groupBy(key).agg(F.min(F.struct(*order, F.col(value).alias("_value")))["_value"].alias(out))


def name_count(df: DataFrame, keys: Sequence[str], out: str, spread: list[str]) -> DataFrame:
    """Number of rows with the same keys on every row; counts are joined back, so that hot keys are split."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return skew_join(df, counts, list(keys), "left", spread)


def explode_strings(df: DataFrame, id_col: str, pairs: Column, out: str = "original_affiliation") -> DataFrame:
    """One row per generated (string, key) pair of a list, with the string; an empty list keeps its row."""
    return df.select(id_col, F.explode_outer(pairs).alias("_pair")).select(id_col, F.col("_pair")[0].alias(out))


# ------------------------------------------------------------ set queries --
def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_rows(*frames).distinct()


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def union_gold(frames: Sequence[DataFrame], text_col: str, order: Sequence[str]) -> DataFrame:
    """Stack labelled sets; a text in several sets keeps the row of the earliest set."""
    ranked = [f.withColumn("_set", F.lit(i)) for i, f in enumerate(frames)]
    return dedupe_first(union_rows(*ranked), [text_col], ["_set", *order]).drop("_set")


def array_union_distinct(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))
