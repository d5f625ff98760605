"""Names contained in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.text import char_windows

# Run length and step of each class of names, by falling name length. A class takes
# names of at least ``length + step - 1`` characters; the last one takes all others.
RUN_CLASSES = ((16, 16), (8, 8), (5, 4), (5, 1), (4, 1), (3, 1), (2, 1), (1, 1))


def contained_name(text: Column, names: Column) -> Column:
    """First name of a list that occurs in the text, or null."""
    return F.get(F.filter(names, lambda n: text.contains(n)), F.lit(0))


def join_contains_candidates(candidates: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names of candidate institutions that occur in the candidate's text.

    ``candidates(text_id, inst_id)``, ``texts(text_id, clean)``, ``names(inst_id, name)``.
    Equi-joins only; containment is tested on the few names of each candidate.
    """
    joined = candidates.join(texts, "text_id").join(names, "inst_id")
    return joined.filter(F.col("clean").contains(F.col("name"))).select("text_id", "inst_id", "name")


def _text_runs(texts: DataFrame, text_id: str, text_col: str, length: int, step: int) -> DataFrame:
    """Hashes of the runs that start at every ``step``-th character."""
    pattern = "(?s)(?=(.{%d})).{1,%d}" % (length, step)
    runs = texts.select(text_id, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("run"))
    return runs.select(text_id, F.xxhash64("run").alias("run"))


def _name_runs(names: DataFrame, name_id: str, name_col: str, length: int, step: int) -> DataFrame:
    """Hashes of all runs of a name in blocks of ``step`` neighbours; incomplete blocks are left out."""
    blocks = F.floor((F.length(name_col) - (length - 1)) / step)
    runs = names.select(
        name_id, blocks.alias("_blocks"), F.posexplode(char_windows(F.col(name_col), length)).alias("_pos", "run"))
    runs = runs.withColumn("block", F.floor(F.col("_pos") / step)).filter(F.col("block") < F.col("_blocks"))
    return runs.select(name_id, "block", F.xxhash64("run").alias("run")).distinct()


def _name_class(c: Column) -> Column:
    return F.coalesce(*[
        F.when(F.length(c) >= length + step - 1, i) for i, (length, step) in enumerate(RUN_CLASSES)
    ])


def join_contains(texts: DataFrame, names: DataFrame, text_id: str, text_col: str,
                  name_id: str, name_col: str) -> DataFrame:
    """All (text, name) pairs where the name occurs in the text, without comparing all pairs.

    Texts are cut into runs at every ``step``-th character. Wherever a name
    occurs, each block of ``step`` neighbouring runs of the name has exactly one
    that meets a cut, so one block is enough to find all texts with the name.
    The block found in the fewest texts is taken, so common beginnings do not
    bring whole groups of texts and names together. Every non-empty name is in
    one length class and matches are verified on the full text: the result is
    exact. Runs travel as 8-byte hashes; with Spark's size check passed for the
    names, only runs that some name has leave the task that reads the text.
    """
    # the same filter everywhere lets Spark compute the runs of the texts once
    texts = texts.select(text_id, text_col).filter(F.col(text_id).isNotNull() & F.col(text_col).isNotNull())
    classed = names.filter(F.col(name_id).isNotNull()).select(name_id, name_col, _name_class(F.col(name_col)).alias("_class"))
    # at most eight rows: the classes that occur
    present = sorted(r[0] for r in classed.select("_class").distinct().collect() if r[0] is not None)
    out = None
    for number in present:
        length, step = RUN_CLASSES[number]
        cls = classed.filter(F.col("_class") == number).select(name_id, name_col)
        name_runs = _name_runs(cls, name_id, name_col, length, step)
        known = _text_runs(texts, text_id, text_col, length, step).join(
            name_runs.select("run").distinct(), "run", "left_semi"
        ).distinct()
        found_in = known.groupBy("run").agg(F.count(F.lit(1)).alias("texts"))
        rarest = (
            name_runs.join(found_in, "run", "left")
            .groupBy(name_id, "block").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"))
            .groupBy(name_id).agg(F.min(F.struct("texts", "block")).alias("best"))
            .filter("best.texts > 0")  # a block no text has: the name occurs nowhere
            .select(name_id, F.col("best.block").alias("block"))
        )
        anchors = name_runs.join(rarest, [name_id, "block"]).select(name_id, "run")
        pairs = known.join(anchors, "run").select(text_id, name_id).distinct()
        checked = (
            pairs.join(cls, name_id).join(texts, text_id)
            .filter(F.col(text_col).contains(F.col(name_col)))
            .select(text_id, name_id)
        )
        out = checked if out is None else out.unionByName(checked)
    if out is None:  # no name at all
        empty = names.select(name_id).filter(F.lit(False))
        out = texts.select(text_id).withColumn("_k", F.lit(0)).join(empty.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return out


def inside_longer(name: Column, all_names: Column) -> Column:
    """The name is strictly inside another name of the list."""
    return F.exists(all_names, lambda m: m.contains(name) & (m != name))


def inside_any(name: Column, names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda p: p.contains(name)), F.lit(False))


def anti_substring(matches: DataFrame, text_id: str = "text_id", name: str = "name") -> DataFrame:
    """Drop matches whose name is strictly inside another match of the same text.

    A text has at most as many matches as candidates, so its list stays small.
    """
    seen = F.collect_set(name).over(Window.partitionBy(text_id))
    return matches.withColumn("_names", seen).filter(~inside_longer(F.col(name), F.col("_names"))).drop("_names")


def anti_primary_name(matches: DataFrame, pick_names: DataFrame, text_id: str = "text_id",
                      name: str = "name") -> DataFrame:
    """Drop matches whose name is inside any name of the text's picked institution.

    ``pick_names(text_id, pick_names array)`` has at most one row per text.
    """
    joined = matches.join(pick_names, text_id, "left")
    return joined.filter(~inside_any(F.col(name), F.col("pick_names"))).select(*matches.columns)
