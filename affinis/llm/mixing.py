"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents stand in a shuffled queue. A document's virtual finish time is the
cumulative size of its source up to it, divided by the source's target; a source may be read
several times over, so a document has one finish time per pass. All finish times are put in
one global order by ranges, and the mix ends where the running size would exceed the budget.

A queue is never one group: its prefix sums are taken in two levels, over buckets of the
shuffle key and inside each bucket, so a source with a third of all rows is spread like any
other. The global order is cut into ranges of the finish time the same way. Windows without a
partition see one row per source, per bucket of one source, or per range.

Defined results: a null text has size 0 and is never taken; null sources form one source, the
last; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import WORD, materialize

#: Rows of one window group, about.
GROUP_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str, keep: list[str]) -> DataFrame:
    """What the mix needs of ``docs``; the columns to keep travel in ``_row``, so their names can't clash."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("_size"), key.alias("_key"), F.struct(*[F.col(c) for c in keep]).alias("_row")
    )


def water_fill(sources: DataFrame, passes: int = 3) -> DataFrame:
    """Target of each source: (source, source_size) gains ``source_no`` and ``target``.

    Weights are 1, 2, 3, repeating in the order of the sources (null last). All sizes are
    shared out by weight; no target exceeds ``passes`` times its source's size, and what is
    cut there goes to the others by weight. With the sources in order of ``cap / weight`` the
    level of the rest follows from two running sums, so no iteration is needed.
    """
    everything = Window.partitionBy(F.lit(0))
    numbered = sources.withColumns({
        "source_no": F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())),
        "_total": F.sum("source_size").over(everything),
    }).withColumns({"_weight": (F.col("source_no") - 1) % 3 + 1, "_cap": F.lit(passes) * F.col("source_size")})
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), "source_no")
    running = numbered.withColumns({
        "_place": F.row_number().over(order),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    fits = F.col("_level") <= F.col("_cap") / F.col("_weight")
    found = running.withColumns({
        "_first": F.min(F.when(fits, F.col("_place"))).over(everything),
        "_share": F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_place"))).over(everything),
    })
    uncapped = F.col("_place") >= F.col("_first")
    target = F.when(F.coalesce(uncapped, F.lit(False)), F.col("_share") * F.col("_weight")).otherwise(F.col("_cap").cast("double"))
    return found.select("source", "source_size", "source_no", target.alias("target"))


def queues(docs: DataFrame, parts: DataFrame, digits: int) -> DataFrame:
    """Sized documents with their source's size and target, and ``_place``: the size of the queue up to and with them."""
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    named = docs.withColumns({"_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "_bucket": F.substring("_key", 1, digits)})
    return named.join(parts, ["_source", "_bucket"]).withColumn("_place", F.col("_offset") + F.sum("_size").over(inside))


def finish(number: int) -> Column:
    """The order of a document's ``number``-th copy: virtual finish time, then what makes it unique."""
    time = ((number - 1) * F.col("source_size") + F.col("_place")) / F.nullif(F.col("target"), F.lit(0.0))
    return F.struct(time.alias("time"), F.col("source_no").alias("source_no"), F.lit(number).alias("copy"), F.col("_place").alias("place"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), passes: int = 3, seed: str = "mix") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes.

    ``taken`` is ``size`` times the number of copies, 0 to ``passes``. A kept column with one of
    those names gives way. Draws depend on ``doc_id`` alone, so reruns agree.
    """
    keep = [c for c in keep if c.lower() not in ("size", "source_size", "target", "taken")]
    wide = not set(keep) <= {"doc_id", "source"}
    full = sized(docs, seed, keep)
    narrow = materialize(full if not wide else full.drop("_row"), "mix-sizes")
    rows = narrow.count()
    digits = 1
    while 16**digits * GROUP_ROWS < rows:
        digits += 1
    by_bucket = narrow.groupBy("source", F.substring("_key", 1, digits).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
    sources = water_fill(by_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), passes)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_bucket.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).alias("b").join(
        sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))
    ).select(
        F.coalesce(F.concat(F.lit("s"), "b.source"), F.lit("n")).alias("_source"), "_bucket", "_offset", "source_size", "source_no", "target"
    )
    parts = materialize(parts, "mix-queues")

    # where the global order ends: ranges of the finish time, then the place inside a range
    entries = queues(narrow, parts, digits).where("_size > 0").select(
        "_size", F.explode(F.array(*[finish(i) for i in range(1, passes + 1)])).alias("_finish")
    )
    per_unit = max(64, rows // 10_000)
    ranged = entries.withColumn("_range", F.floor(F.col("_finish.time") * per_unit))
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    lower = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    budget = parts.groupBy("_source").agg(F.first("source_size").alias("n")).agg(F.sum("n")).scalar()
    sums = sums.withColumn("_under", F.coalesce(F.sum("_sum").over(lower), F.lit(0)))
    order = Window.partitionBy("_range").orderBy("_finish").rowsBetween(Window.unboundedPreceding, 0)
    taken = ranged.join(sums.where(F.col("_under") < budget).select("_range", "_under"), "_range").withColumn(
        "_running", F.col("_under") + F.sum("_size").over(order)
    ).where(F.col("_running") <= budget)
    cut = materialize(taken.agg(F.max("_finish").alias("last")), "mix-cut").scalar()

    copies = sum((F.coalesce(finish(i) <= cut, F.lit(False)).cast("long") for i in range(1, passes + 1)), F.lit(0).cast("long"))
    taken = F.when(F.col("_size") > 0, F.col("_size") * copies).otherwise(F.lit(0).cast("long"))
    placed = queues(full if wide else narrow, parts, digits)
    return placed.select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, passes: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    out = mix(packed, ("document",), passes).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return out.select("document.*")
