"""Phrase collocations by dynamic itemset counting over the shards of a corpus.

The corpus is cut once into chunks of words (numbers into the chunk's own list of words; breaks
between pieces) and dealt over ``SHARDS`` shards in the shared folder. Scans go round the shards,
one a step, and count phrases of all lengths at once: words from step 0 on, a longer phrase from
the step after both its subphrases, all but its last and all but its first word, have reached the
threshold. A phrase is counted for one full cycle, so its count is exact wherever in the cycle it
began; it is then complete, and goes if it stayed below the threshold. Steps end when all phrases
are complete. As lengths overlap, few more scans are made than one length alone needs.

The state, a table of phrases with count, first step and the step in which the threshold was
reached, is written anew after each step; it holds open phrases and complete frequent ones.
What a scan needs to know of it is no broadcast table but an array of fixed size (``FILTER_SIZE``)
that says for the hash of a phrase in which step it reached the threshold. A place is set once and
stays, so the place decides when a phrase that two others share it with becomes active: too early
or for nothing, but for one full cycle all the same, and no phrase that should be counted is
missed. Counts are exact whatever the size of the array. They are summed in a chunk first, so a
frequent word or phrase is one row a chunk. Once the words are complete, the chunks are written
again without the rare ones, which no frequent phrase can have.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count each; an
empty table gives an empty result. Columns other than text and lang take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import blocks_of, in_small_batches, materialize, scratch_path, texts_of

#: Phrases of 2 to 5 words, counted 100 times at least; the best of a language.
LONGEST, LEAST, BEST = 5, 100, 2000
#: Shards of a cycle, and places for hashes (a power of two, 32768 at least; with more phrases than places scans report more, not less).
SHARDS, FILTER_SIZE = 3, 1 << 24
BLOCK_BYTES, CHUNK_WORDS = 8 << 20, 200_000
_TURN = 13  # bits by which the hash of each next word of a phrase is turned
CORPUS = "shard int, lang string, n long, words binary, ids binary"
#: Chunks that go to a worker at a time (about a megabyte each), and bytes of a row group, which readers hold as a whole.
BATCH_CHUNKS, GROUP_BYTES = 4, 8 << 20
COUNTS = "lang string, size int, phrase string, start int, n long"


def _byte_table():
    """A-Z in lower case; and the kind of a byte: 0 for white space inside a piece, 1 for what ends a piece, 2 for parts of words."""
    import numpy as np

    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, 2, np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    kind[[0x20, 0x09]] = 0
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
    return lower, kind


def _pieces(texts: list[bytes]):
    """All words as one Arrow column, and for each whether a piece begins with it."""
    import numpy as np
    import pyarrow as pa

    from affinis.llm.hashing import joined, runs

    data, _ = joined(texts)  # a line feed, which ends a piece, after each text
    lower, kinds = _byte_table()
    kind = kinds[data]
    starts, ends = runs(kind == 2)
    breaks = np.cumsum(kind == 1)[starts] if len(starts) else np.empty(0, np.int64)
    opens = np.append(True, breaks[1:] != breaks[:-1])[: len(starts)]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lower[data[kind == 2]])]), opens


def _chunk(shard: int, lang: str, n: int, words, ids):
    """A row of the corpus: words, which hold no space, joined by one, and numbers of words as bytes."""
    import pyarrow as pa

    columns = [pa.array([shard], pa.int32()), pa.array([lang], pa.string()), pa.array([n], pa.int64())]
    columns += [pa.array([value], pa.binary()) for value in (b" ".join(words.cast(pa.large_binary()).to_pylist()), ids.astype("<i4").tobytes())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "n", "words", "ids"])


def _chunks(batches: Iterable) -> Iterator[tuple]:
    """(lang, words, ids) of each chunk, and its further columns."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            chunk = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            words = pa.array(chunk.pop("words").split(b" "), pa.binary()).cast(pa.string())
            ids = np.frombuffer(chunk.pop("ids"), "<i4")
            yield chunk.pop("lang"), words if (ids >= 0).any() else words.slice(0, 0), ids, chunk


def _cut(shards: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        for block in blocks_of(batches, BLOCK_BYTES):
            texts, by = texts_of(block.column("text")), {}
            for n, lang in enumerate(block.column("lang").to_pylist()):
                by.setdefault(lang, []).append(texts[n])
            for lang, own in by.items():
                words, opens = _pieces(own)
                begins = np.flatnonzero(opens)
                at = 0
                while at < len(words):
                    later = begins[np.searchsorted(begins, at + CHUNK_WORDS) :]
                    end = int(later[0]) if len(later) else len(words)
                    coded = words.slice(at, end - at).dictionary_encode()
                    first = np.flatnonzero(opens[at:end])
                    ids = np.insert(coded.indices.to_numpy().astype(np.int32), first, -1)
                    yield _chunk(turn % shards, lang, end - at, coded.dictionary, ids)
                    at, turn = end, turn + 1

    return run


def _corpus(docs: DataFrame, shards: int) -> DataFrame:
    """The chunks, in a folder for each shard."""
    texts = in_small_batches(docs).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return _stored(texts.mapInArrow(_cut(shards), CORPUS))


def _stored(chunks: DataFrame) -> DataFrame:
    path = scratch_path(chunks.sparkSession, "collocation-chunks")
    small = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
    chunks.write.options(compression="zstd", **small).partitionBy("shard").parquet(path)
    return chunks.sparkSession.read.schema(CORPUS).parquet(path)


def _turned(hashes, place: int):
    import numpy as np

    by = _TURN * place % 64
    return hashes if not by else (hashes << np.uint64(by)) | (hashes >> np.uint64(64 - by))


def _hashed(spelled: list[str]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode(), 42) for w in spelled), np.uint64, len(spelled))


def _times(times, hashes):
    """When the places of the hashes were set, counted from 1; 0 for never."""
    import numpy as np

    return times[(hashes & np.uint64(len(times) - 1)).astype(np.int64)]


def counted(lang: str, words, ids, times, step: int, shards: int, longest: int) -> Iterator[tuple]:
    """(size, phrases, first steps, counts) of a chunk: its words in the first cycle, and the longer phrases that are active."""
    import numpy as np
    import pyarrow.compute as pc

    inside = ids >= 0
    if step < shards:
        yield 1, words, np.zeros(len(words), np.int32), np.bincount(ids[inside], minlength=len(words))
    if not step:
        return
    hashes = np.append(_hashed(words.to_pylist()), np.uint64(0))[ids]
    # of the phrase of ``size`` words that begins at a place: its hash, and the step after it reached the threshold (0: not yet)
    own = hashes ^ _hashed([lang])[0]
    known = np.where(inside, _times(times, own), 0)
    for size in range(2, longest + 1):
        both = (known[:-1] > 0) & (known[1:] > 0)
        if not both.any():
            return
        start = np.maximum(known[:-1], known[1:])
        at = np.flatnonzero(both & (start > step - shards))
        if len(at):
            key = ids[at].astype(np.int64)
            for ahead in range(1, size):
                _, first, key, counts = np.unique(key * len(words) + ids[at + ahead], return_index=True, return_inverse=True, return_counts=True)
            places = at[first]
            yield size, pc.binary_join_element_wise(*[words.take(ids[places + j]) for j in range(size)], " "), start[places].astype(np.int32), counts
        if size < longest:
            own = own[:-1] ^ _turned(hashes[size - 1 :], size - 1)
            later = _times(times, own)  # never before what the phrase consists of
            known = np.where(both & (later > 0), np.maximum(later, start), 0)


def _scan(sent, step: int, shards: int, longest: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        times = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for lang, words, ids, _ in _chunks(batches):
            for size, phrases, start, counts in counted(lang, words, ids, times, step, shards, longest):
                n = len(phrases)
                columns = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(size, pa.int32()), n), phrases.cast(pa.string()), pa.array(start), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "start", "n"])

    return run


def _without_rare(sent):
    """Chunks in which words that have not reached the threshold end the piece."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        times = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for lang, words, ids, chunk in _chunks(batches):
            kept = _times(times, _hashed(words.to_pylist()) ^ _hashed([lang])[0]) > 0
            number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype(np.int32)
            ids = number[ids]
            ids = ids[(ids >= 0) | (np.append(-1, ids[:-1]) >= 0)]  # one break in a row
            yield _chunk(chunk["shard"], lang, chunk["n"], words.filter(pa.array(kept)), ids)

    return run


def _hash(longest: int) -> Column:
    """The hash of (lang, phrase) as ``counted`` makes it."""
    words = F.split("phrase", " ", -1)

    def of(place: int) -> Column:
        h, by = F.xxhash64(F.get(words, F.lit(place))), _TURN * place % 64
        return h if not by else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))

    parts = [F.when(F.col("size") > j, of(j)).otherwise(F.lit(0)) for j in range(longest - 1)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.xxhash64("lang"))


def _note(times, state: DataFrame, step: int, longest: int) -> bool:
    """Sets in ``times`` the places of the phrases that reached the threshold in this step, where none is set; whether there are any.

    The driver gets a bitmap of fixed size, in parts of 4096 bytes.
    """
    import numpy as np

    at = _hash(longest).bitwiseAND(F.lit(len(times) - 1)) + 1  # these functions number bits from 1
    fresh = state.where((F.col("reached") == step) & (F.col("size") < longest))
    fresh = fresh.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    found = fresh.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    for part in found:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(part.bits, np.uint8), bitorder="little")) + (part.bucket - 1) * 32768
        places = places[times[places] == 0]
        times[places] = step + 1
    return bool(found)


@contextmanager
def _few_chunks(spark: SparkSession) -> Iterator[None]:
    """Jobs within send Python workers ``BATCH_CHUNKS`` rows at a time: a task's chunks would go in one batch else, however many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_CHUNKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent(corpus: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, filter_size: int = FILTER_SIZE) -> DataFrame:
    """lang, size, phrase, n of every phrase of 1 to ``longest`` words that is counted ``least`` times or more."""
    with _few_chunks(corpus.sparkSession):
        return _frequent(corpus, least, longest, shards, filter_size)


def _frequent(corpus: DataFrame, least: int, longest: int, shards: int, filter_size: int) -> DataFrame:
    import numpy as np

    context = corpus.sparkSession.sparkContext
    times = np.zeros(filter_size, np.uint8)
    state, step, last = None, 0, -1
    while step < shards or step <= last + shards:
        sent = context.broadcast(zlib.compress(times.tobytes(), 1))
        if step == shards:  # the words are complete
            corpus = _stored(corpus.mapInArrow(_without_rare(sent), CORPUS))
        grown = corpus.where(F.col("shard") == step % shards).select("lang", "words", "ids").mapInArrow(_scan(sent, step, shards, longest), COUNTS)
        grown = grown.withColumn("reached", F.lit(None).cast("int"))
        if state is not None:
            grown = grown.unionByName(state)
        grown = grown.groupBy("lang", "size", "phrase").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("reached").alias("reached"))
        reached = F.coalesce("reached", F.when(F.col("n") >= least, F.lit(step)))
        open_ = F.col("start") + shards - 1 > step
        state = materialize(grown.withColumn("reached", reached).where(F.col("reached").isNotNull() | open_), "collocation-state")
        if _note(times, state, step, longest):
            last = step
        sent.unpersist()
        step += 1
    return state.where(F.col("reached").isNotNull()).select("lang", "size", "phrase", "n")


def _part(begin: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " ", -1), begin, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, n, score of every phrase of two words or more, by its lowest-scoring cut; ``totals`` has lang and n."""
    exact = "decimal(38,0)"
    cuts = phrases.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", _part(F.lit(1), F.col("cut"))).withColumn("rest", _part(F.col("cut") + 1, F.col("size")))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    cuts = cuts.join(totals, "lang")
    cuts = cuts.withColumn("above", (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    cuts = cuts.withColumn("below", F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    cuts = cuts.withColumn("score", F.expr(f"cast(above as {exact}) div cast(below as {exact})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "size", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "best.size", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, shards: int = SHARDS, filter_size: int = FILTER_SIZE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language.

    Phrases that lie inside a longer one counted at least as often are dropped. Ranking keeps the
    best of each task before the shuffle.
    """
    corpus = _corpus(docs, shards)
    phrases = materialize(frequent(corpus, least, longest, shards, filter_size), "collocation-phrases")
    marked = scored(phrases, corpus.groupBy("lang").agg(F.sum("n").alias("n")))
    spans = [(begin, length) for length in range(2, longest) for begin in range(longest - length + 1)]
    inner = F.array(*[F.when(F.col("size") >= max(begin + length, length + 1), _part(F.lit(begin + 1), F.lit(length))) for begin, length in spans] or [F.lit(None).cast("string")])
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("over")).where("phrase is not null")
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = marked.join(longer, ["lang", "phrase"], "left").where("over is null or 100 * over < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
