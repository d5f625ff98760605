"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.session import materialize, scratch_path

__all__ = ["WORD", "WHITE_SPACE", "held_out", "in_small_batches", "least_hashed", "materialize", "scratch_path", "table", "texts_of", "blocks_of"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text that go to a Python worker at a time.
BATCH_ROWS = 1000
#: Tasks that the rows of one label are dealt over.
SALTS = 16
#: The characters between words.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents no model may learn labels from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; the session hands Python workers 1000 rows at a time, as texts are long, unless it asks for fewer."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def least_hashed(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows of the ``n`` least hashes of doc_id for each label, with their ``place``.

    A label's rows are first dealt over ``SALTS`` tasks, which keep ``n`` each, so that at most
    ``SALTS * n`` rows of a label meet in one.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), *[F.col(c) for c in df.columns if c not in ("doc_id", label)]]
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)))
    kept = dealt.withColumn("place", F.row_number().over(Window.partitionBy(label, "_salt").orderBy(*order))).where(F.col("place") <= n)
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return kept.drop("_salt", "place").withColumn("place", place).where(F.col("place") <= n)


def texts_of(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def blocks_of(batches: Iterable, text_bytes: int, column: str = "text") -> Iterator:
    """Arrow tables of about ``text_bytes`` of text (one row at least), in order.

    What a task keeps at a time is bounded by ``text_bytes`` and its longest text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, n in enumerate(sizes):
            size += int(n)
            if size >= text_bytes:
                held.append(batch.slice(start, row + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, row + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
