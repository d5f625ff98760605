"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint takes each bit that over half of its shingle hashes have. Two fingerprints
link at ``distance`` or fewer differing bits. Candidates come from the pigeonring principle: the
64 bits are cut into ``SEGMENTS`` segments on a ring; for a linked pair some segment exists from
which every chain of 1, 2, 3, ... consecutive segments differs in at most its proportional budget
``length * distance / SEGMENTS``. Chains whose budget is below 1 must be equal, so the longest such
chain is an equality join key; the longer chains are then checked on the joined pair, and only
survivors reach the full Hamming check.

Documents are grouped by fingerprint first, so copies cost one row. A fingerprint has at most
as many links as there are bit patterns within ``distance``, whatever the group of copies.
Components come from alternating large-star and small-star steps over the links, each step
written to the shared folder.

Defined results: a null or empty text, or one without words, has fingerprint 0 and is linked like
any other; repeated rows are separate rows of one fingerprint; a null doc_id never names a
component unless all of its members are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from affinis.llm.common import blocks_of, in_small_batches, materialize, texts_of

BITS = 64
SEED = 42
SEGMENTS = 5
BLOCK_BYTES = 4 << 20


def _bit_votes(hashes, starts):
    """Bits set in over half of the hashes of each run; ``starts`` has the first of each run, none empty."""
    import numpy as np

    ends = np.append(starts[1:], len(hashes))
    # runs are cut into pieces of at most 255 hashes, so that a byte can count a bit
    pieces = -(-(ends - starts) // 255)
    first = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    run = np.cumsum(pieces) - pieces
    low = np.uint64(0x0101010101010101)
    prints = np.zeros(len(starts), np.uint64)
    half = (ends - starts)[:, None]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & low, first)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run, axis=0)
        votes = (2 * counts > half).astype(np.uint64)
        for lane in range(8):  # little-endian: lane 0 counts bits 0 to 7
            prints |= votes[:, lane] << np.uint64(8 * lane + shift)
    return prints


def _fingerprints(width: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for block in blocks_of(batches, BLOCK_BYTES):
            hashes, starts, filled, total = [], [], [], 0
            texts = texts_of(block.column("text"))
            for number, text in enumerate(texts):
                words = text.lower().split()  # of bytes: A-Z and ASCII white space only
                if not words:
                    continue
                shingles = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)))] if len(words) >= width else [b" ".join(words)]
                hashes.append(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))
                starts.append(total)
                filled.append(number)
                total += len(shingles)
            prints = np.zeros(len(texts), np.uint64)
            if filled:
                prints[filled] = _bit_votes(np.concatenate(hashes), np.array(starts))
            yield from block.drop_columns(["text"]).append_column("print", pa.array(prints.view(np.int64))).to_batches()

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with ``print``, the fingerprint of its text as a signed long, in place of ``text``."""
    rest = [f for f in in_small_batches(docs).schema if f.name != "text"]
    return docs.select("text", *[f.name for f in rest]).mapInArrow(_fingerprints(width), StructType([*rest, StructField("print", LongType())]))


def _segments(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    mask = sum(((1 << bits) - 1) << low for low, bits in (ring[(start + i) % len(ring)] for i in range(length)))
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a < b of different fingerprints (column ``print``, distinct) at most ``distance`` bits apart."""
    ring = _segments(segments)
    budgets = [length * distance // segments for length in range(1, segments + 1)]
    exact = sum(b == 0 for b in budgets)
    if not exact:
        raise ValueError(f"{segments} segments are too few for a distance of {distance}")
    keyed = prints.select(
        "print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(_mask(ring, i, exact))) for i in range(segments)])).alias("start", "key")
    )
    a = keyed.select(F.col("print").alias("a"), "start", "key")
    b = keyed.select(F.col("print").alias("b"), "start", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))

    def chains(start: int) -> Column:
        within = F.lit(True)
        for length in range(exact + 1, segments + 1):
            within &= F.bit_count(differ.bitwiseAND(F.lit(_mask(ring, start, length)))) <= budgets[length - 1]
        return within

    passes = F.lit(False)
    for start in range(segments):
        passes |= (F.col("start") == start) & chains(start)
    pairs = a.join(b, ["start", "key"]).where(F.col("a") < F.col("b")).where(passes)
    return pairs.where(F.bit_count(differ) <= distance).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for every node of the edges (a, b).

    Large-star and small-star steps; the edges of a round are written to the shared folder, so
    nothing depends on what an executor holds. Ends when a round changes no edge.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the least of its neighbours and itself
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the neighbours below a node, and the node, go to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = materialize(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
            "links",
        )
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def classes(prints: DataFrame, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """print, root (the component's least fingerprint) and component_id, one row per fingerprint of ``prints`` (doc_id, print)."""
    first = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    reached = components(links(first, distance, segments))
    labelled = first.join(reached, first.print == reached.node, "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(smallest, "root").select("print", "root", "component_id")


def near_groups(docs: DataFrame, width: int = 3, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    The last join meets a class with a third of all rows: those rows are numbers only, and
    adaptive execution splits them.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), width), "prints")
    found = prints.join(classes(prints, distance, segments), "print")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_deduplicated(docs: DataFrame, width: int = 3, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (null last), then text digest."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    prints = materialize(fingerprints(docs.select("doc_id", "text", name, digest), width), "prints")
    grouped = prints.join(classes(prints, distance, segments), "print")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "name")
    kept = grouped.groupBy("root").agg(F.min(order).alias("first")).select("first.name", "first.digest")
    packed = docs.select(name, digest, F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    place = F.row_number().over(Window.partitionBy("name", "digest").orderBy(F.xxhash64("document")))
    return packed.withColumn("place", place).where("place = 1").join(kept, ["name", "digest"], "left_semi").select("document.*")
