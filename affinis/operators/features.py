"""Model input: vocabularies, token ids, dense indexes, shards and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.draws import draw_key
from affinis.functions.text import UNKNOWN_TOKEN, pad_truncate, word_tokens
from affinis.operators.skew import salted_lookup

# --- fixed values: vocabulary size, model input length, batch and shard sizes ---
VOCAB_SIZE = 3816
INPUT_LENGTH = 128
BATCH_ROWS = 512
TRAIN_SHARD_ROWS = 500_000
VAL_SHARD_ROWS = 60_000
SHARD_DIGITS = 4

# rows that one task numbers, about
BUCKET_ROWS = 100_000


def dense_index(df: DataFrame, key: list[str], within: list[str] | None = None, out: str = "idx",
                seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Gap-free 0-based row index in random order, per group of ``within`` columns.

    ``key`` must identify a row. Rows fall into hash buckets of equal size, so
    many that a bucket has about ``bucket_rows`` rows (one count decides); only
    the bucket counts are summed up in one place, rows are numbered inside their
    bucket. A group holding most rows is spread like any other, and the index
    does not depend on the number of buckets.
    """
    within = within or []
    rows, digits = df.count(), 1
    while 16**digits * bucket_rows < rows:
        digits += 1
    hashed = df.withColumn("_h", draw_key(seed, *key)).withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*within, "_b").orderBy("_h", *key)
    numbered = hashed.withColumn("_r", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*within, "_b"])
        .withColumn(out, (F.col("_offset") + F.col("_r") - 1).cast("bigint"))
        .select(*df.columns, out)
    )


def shard_rows(df: DataFrame, key: list[str], rows_per_shard: int, within: list[str] | None = None) -> DataFrame:
    """Add the row index and the name of its fixed-size shard, padded to four digits and never cut."""
    indexed = dense_index(df, key, within)
    number = F.floor(F.col("idx") / rows_per_shard).cast("string")
    return indexed.withColumn("shard", F.lpad(number, F.greatest(F.length(number), F.lit(SHARD_DIGITS)), F.lit("0")))


def full_batches(df: DataFrame, batch_rows: int = BATCH_ROWS, within: list[str] | None = None,
                 drop_last: bool = True) -> DataFrame:
    """Number batches from ``idx``; the incomplete last batch is dropped as a whole."""
    within = within or []
    out = df.withColumn("batch", F.floor(F.col("idx") / batch_rows).cast("bigint"))
    if not drop_last:
        return out
    if not within:
        total = df.agg(F.count(F.lit(1))).scalar()
        return out.filter((F.col("batch") + 1) * batch_rows <= total)
    # one row per split: a handful, so it always fits a broadcast
    totals = F.broadcast(df.groupBy(*within).agg(F.count(F.lit(1)).alias("_total")))
    return out.join(totals, within).filter((F.col("batch") + 1) * batch_rows <= F.col("_total")).drop("_total")


def label_index(ids: DataFrame, id_col: str = "inst_id", out: str = "label") -> DataFrame:
    """Integer label per distinct id; ``-1`` (no institution) is always 0."""
    real = ids.select(id_col).filter(F.col(id_col).isNotNull() & (F.col(id_col) != -1)).distinct()
    indexed = dense_index(real, [id_col], out=out).withColumn(out, F.col(out) + 1)
    none = ids.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias(id_col), F.lit(0).cast("bigint").alias(out))
    return indexed.withColumn(id_col, F.col(id_col).cast("bigint")).unionByName(none)


def encode_labels(df: DataFrame, vocab: DataFrame, id_col: str, label_col: str = "label",
                  spread: list[str] | None = None) -> DataFrame:
    """Label of each row's id, null for an id the vocabulary does not hold."""
    return salted_lookup(df, vocab, id_col, "left", spread)


def term_frequency(df: DataFrame, text_col: str, size: int = VOCAB_SIZE) -> DataFrame:
    """The ``size`` most frequent tokens with their counts."""
    tokens = df.select(F.explode(word_tokens(F.col(text_col))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(size)


def token_vocab(frequencies: DataFrame) -> DataFrame:
    """Token ids by falling frequency; the unknown token is 0. At most ``VOCAB_SIZE`` rows."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    none = frequencies.sparkSession.range(1).select(F.lit(UNKNOWN_TOKEN).alias("token"), F.lit(0).alias("token_id"))
    return frequencies.select("token", rank.alias("token_id")).unionByName(none)


def encode_tokens(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, out: str = "token_ids",
                  max_tokens: int | None = None) -> DataFrame:
    """Token ids of each text in order, unknown tokens as 0.

    The vocabulary has a fixed size limit, so it is broadcast. ``max_tokens``
    stops after that many tokens when only a fixed input length is needed.
    """
    tokens = word_tokens(F.col(text_col))
    if max_tokens:
        tokens = F.slice(tokens, 1, max_tokens)
    # texts are dealt by id while each is one row; tokens stay in that task
    texts = df.select(id_col, text_col).repartition(id_col)
    exploded = texts.select(id_col, F.posexplode_outer(tokens).alias("_pos", "token"))
    ids = exploded.join(F.broadcast(vocab), "token", "left").select(
        id_col, F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("token_id", F.lit(0)).alias("t"))).alias("p")
    )
    grouped = ids.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return grouped.select(id_col, F.transform("p", lambda x: x["t"]).alias(out))


def model_input(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str,
                length: int = INPUT_LENGTH) -> DataFrame:
    """Token ids cut and padded to the fixed input length."""
    encoded = encode_tokens(df, vocab, id_col, text_col, "_ids", length)
    return encoded.select(id_col, pad_truncate(F.col("_ids"), length).alias("model_input"))
