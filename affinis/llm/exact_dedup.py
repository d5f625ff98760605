"""Exact dedup by an extendible-hash index on shared files.

1. Entries. Each task combines its own equal texts, a block at a time, and writes to the shared
   folder one entry per row; only the first row of a text in a block carries the text itself.
   A text that makes up a third of all rows is thus sent on once per block, not once per row.
2. Directory. A text's key is the 64-bit hash of its normalised form. The directory starts with
   few leading bits; every bucket that holds more keys than fit is split by one more bit (the
   directory doubles) until all fit. Copies of one text count as one key, since no number of bits
   separates them.
3. Owners. The buckets are ranges of keys; each owner task gets a run of them in order of the key
   and reads it as a stream. Texts under one key form a chain and are compared byte by byte, so
   a hash collision never joins two texts. A task keeps the chain of one key at a time.
4. Each row finds its text's group through the number of its entry.

Defined results: a null text is an empty one, and all empty texts are equal; of rows equal in
length and doc_id one stays; a null doc_id comes after all others; an empty table gives an
empty result. Columns of ``docs`` other than doc_id and text take no part unless kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import WHITE_SPACE, blocks_of, in_small_batches, materialize, texts_of

#: An entry per row; the last five are filled where ``row = entry``, for all of the block's copies together.
ENTRY = (
    "row long, doc_id long, entry long, key long, text_sha256 string, "
    "normal binary, copies long, best_points long, best_id long, best_row long"
)
OWNED = "entry long, keep_row long, keep_id long, group_size long"
BLOCK_BYTES = 8 << 20
#: Keys of a bucket before it is split.
BUCKET_KEYS = 1024
#: Buckets that one owner task gets at least, and the most owner tasks.
OWNER_BUCKETS, OWNERS = 2, 50_000


def _rank(code_points: int, doc_id: int | None, row: int) -> tuple:
    """The row that sorts first stays."""
    return -code_points, doc_id is None, doc_id or 0, row


def _entries(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import xxhash
    from pyspark import TaskContext

    space = WHITE_SPACE.encode()
    row = TaskContext.get().partitionId() << 40  # a partition has fewer rows than that
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()] + [pa.int64()] * 4
    names = ["row", "doc_id", "entry", "key", "text_sha256", "normal", "copies", "best_points", "best_id", "best_row"]
    for block in blocks_of(batches, BLOCK_BYTES):
        groups: dict[bytes, list] = {}
        members = []
        for doc_id, text in zip(block.column("doc_id").to_pylist(), texts_of(block.column("text"))):
            normal = text.translate(None, space)
            points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
            rank = _rank(points, doc_id, row)
            group = groups.get(normal)
            if group is None:
                group = groups[normal] = [row, xxhash.xxh64_intdigest(normal) - (1 << 63), hashlib.sha256(normal).hexdigest(), normal, 0, rank]
            group[4] += 1
            group[5] = min(group[5], rank)
            members.append((row, doc_id, group))
            row += 1
        rows = []
        for own, doc_id, (entry, key, digest, normal, copies, (points, none, best_id, best_row)) in members:
            mine = (normal, copies, -points, None if none else best_id, best_row) if own == entry else (None,) * 5
            rows.append((own, doc_id, entry, key, digest, *mine))
        for start in range(0, len(rows), 500):
            columns = zip(*rows[start : start + 500])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def prefix(key: Column, bits: int) -> Column:
    """The leading bits of a signed key, as a number that keeps the order of the keys."""
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The leaves of the index over the column ``key``: bits, bucket, keys, and ``low``, the least key they can hold.

    It starts with as many bits as even keys need. Each round doubles the directory and reads
    only the keys of the buckets that were overfull; it ends at 63 bits at the latest.
    """
    left = materialize(keys.select("key").distinct(), "dedup-keys")
    bits = max(0, (left.count() // bucket_keys).bit_length() - 1)
    leaves = None
    while True:
        counted = left.groupBy(prefix(F.col("key"), bits).alias("bucket")).agg(F.count(F.lit(1)).alias("keys"))
        counted = materialize(counted.withColumn("full", (F.col("keys") > bucket_keys) & F.lit(bits < 63)), "dedup-level")
        low = F.shiftleft("bucket", 64 - bits) if bits else F.lit(-(2**63))
        found = counted.where(~F.col("full")).select(F.lit(bits).alias("bits"), "bucket", "keys", low.alias("low"))
        leaves = found if leaves is None else leaves.union(found)
        full = counted.where("full").select("bucket")
        if full.isEmpty():
            return leaves
        left = left.withColumn("bucket", prefix(F.col("key"), bits)).join(full, "bucket", "left_semi").drop("bucket")
        bits += 1


def owner_bounds(leaves: DataFrame) -> list[int]:
    """The least key of every owner but the first: runs of neighbouring buckets with about as many keys each.

    At most ``OWNERS`` numbers reach the driver, however large the index.
    """
    buckets, keys = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("keys"), F.lit(0))).first()
    owners = max(1, min(buckets // OWNER_BUCKETS, OWNERS))
    before = F.sum("keys").over(Window.partitionBy(F.lit(0)).orderBy("low")) - F.col("keys")
    owner = F.floor(before * owners / F.lit(max(1, keys)))
    return sorted(r.low for r in leaves.withColumn("owner", owner).groupBy("owner").agg(F.min("low").alias("low")).collect())[1:]


def _owners(batches: Iterable) -> Iterator:
    """Rows come in order of the key; the chain of a key has its different texts, with all entries of each."""
    key, chain, ready = None, [], []
    names = ("key", "entry", "normal", "copies", "best_points", "best_id", "best_row")
    for batch in batches:
        for k, entry, normal, copies, *best in zip(*(batch.column(c).to_pylist() for c in names)):
            if k != key:
                ready += chain
                key, chain = k, []
            rank = _rank(*best)
            for link in chain:
                if link[0] == normal:
                    link[1], link[2] = min(link[1], rank), link[2] + copies
                    link[3].append(entry)
                    break
            else:
                chain.append([normal, rank, copies, array("q", [entry])])
        if ready:
            yield _packed(ready)
            ready = []
    ready += chain
    if ready:
        yield _packed(ready)


def _packed(chain: list):
    """Arrow rows of finished chains."""
    import numpy as np
    import pyarrow as pa

    sizes = [len(entries) for *_, entries in chain]
    spread = lambda values: pa.array(values, pa.int64()).take(pa.array(np.repeat(np.arange(len(chain)), sizes)))
    columns = [
        pa.array(np.concatenate([np.frombuffer(e, np.int64) for *_, e in chain])),
        spread([rank[3] for _, rank, _, _ in chain]),
        spread([None if rank[1] else rank[2] for _, rank, _, _ in chain]),
        spread([size for _, _, size, _ in chain]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["entry", "keep_row", "keep_id", "group_size"])


def dedup_groups(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    entries = materialize(in_small_batches(docs).select("doc_id", "text").mapInArrow(_entries, ENTRY), "dedup-entries")
    texts = entries.where(F.col("normal").isNotNull())
    bounds = owner_bounds(materialize(directory(texts, bucket_keys), "dedup-directory"))

    @F.pandas_udf("int")
    def owner(keys: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(), side="right").astype("int32"))

    owned = (
        texts.select(owner("key").alias("owner"), "key", "entry", "normal", "copies", "best_points", "best_id", "best_row")
        .repartition(len(bounds) + 1, "owner")
        .sortWithinPartitions("owner", "key")
        .mapInArrow(_owners, OWNED)
    )
    groups = entries.select("row", "doc_id", "entry", "text_sha256").join(owned, "entry")
    return groups.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows alike in doc_id and text one stays."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    kept = dedup_groups(docs, bucket_keys).where("kept").select(name, F.col("text_sha256").alias("digest"))
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(
        name, F.sha2(F.translate(text, WHITE_SPACE, ""), 256).alias("digest"),
        F.length(text).alias("points"), F.struct(*[F.col(c) for c in docs.columns]).alias("document"),
    )
    first = F.row_number().over(Window.partitionBy("name", "digest").orderBy(F.desc("points"), F.xxhash64("document")))
    return packed.withColumn("place", first).where("place = 1").join(kept, ["name", "digest"], "left_semi").select("document.*")
