"""Benchmark decontamination: suffix arrays over the documents, searched for every suffix of the benchmark.

Words are runs of ASCII letters and digits and of all other characters than ASCII ones, with A-Z in
lower case. Each task takes its documents in shards of bounded size, numbers the distinct words of
a shard and sorts all suffixes of its word sequence: first by as many words as fit in one integer,
then by doubling the compared length for those that are still tied, up to the longest item. The
benchmark is cut into blocks of bounded size in the shared folder; every suffix of every item is
searched in every shard by binary search, all suffixes at once and a word at a time, which narrows
its range of the array until nothing matches: the depth is its longest verbatim match there, and
the range has the locations. Nothing is shuffled but the results of ``longest_matches``.

A window is ``WINDOW`` words of an item, or all words of a shorter one. An occurrence of a window
is an entry of the range at that depth; its words are hit.

Defined results: a null text has no words; an item without words matches nothing; items are told
apart by item_id, and all without one are one item, listed as an empty string; repeated rows of
documents are answered each; an empty benchmark hits nothing. Kept columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from affinis.llm.common import blocks_of, in_small_batches, materialize, scratch_path, texts_of

WINDOW = 10
#: Bytes of text that a task holds, words of a suffix array, and words of a block of the benchmark.
BLOCK_BYTES, SHARD_WORDS, ITEM_WORDS = 4 << 20, 1 << 20, 1 << 20


def _byte_table():
    """A-Z in lower case; 0 for bytes between words."""
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    kept = [*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]
    between = np.ones(256, bool)
    between[kept] = False
    table[between] = 0
    return table


def words_of(texts: list[bytes]):
    """The words of all texts as one Arrow column, and for each the number of its text."""
    import numpy as np
    import pyarrow as pa

    from affinis.llm.hashing import joined, runs

    data, firsts = joined(texts)
    data = _byte_table()[data]
    starts, ends = runs(data != 0)
    letters = data[data != 0]
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    return words, np.searchsorted(firsts, starts, "right") - 1


class SuffixArray:
    """The suffixes of ``units`` in the order of their first ``depth`` units; unit 0 ends a text and matches nothing."""

    def __init__(self, units, depth: int) -> None:
        import numpy as np

        n = len(units)
        bits = int(units.max(initial=0)).bit_length() or 1
        width = min(max(1, 62 // bits), max(1, depth))
        self.padded = np.concatenate((units, np.zeros(depth + width, units.dtype)))
        key = np.zeros(n, np.int64)
        for ahead in range(width):
            key <<= bits
            key |= self.padded[ahead : ahead + n]
        order = np.argsort(key)
        key = key[order]
        opens = np.append(True, key[1:] != key[:-1])  # where a group of equal prefixes begins
        rank = np.zeros(n + depth + width, np.int64)  # past the end: the least
        while n:
            place = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            tied = np.flatnonzero(~(opens & np.append(opens[1:], True)))
            if width >= depth or not len(tied):
                break
            rank[order] = place + 1
            own = order[tied]
            second = rank[np.minimum(own + width, n)]
            place = place[tied]
            by = np.lexsort((second, place))
            order[tied] = own[by]
            second = second[by]
            opens[tied[1:]] |= second[1:] != second[:-1]
            width *= 2
        self.order, self.depth = order, depth

    def _narrowed(self, low, high, ahead, wanted, after: bool):
        """Where in ``order[low:high]`` the units ``ahead`` of the suffixes reach ``wanted``, or pass it if ``after``."""
        import numpy as np

        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            found = self.padded[self.order[middle] + ahead]
            right = found <= wanted[open_] if after else found < wanted[open_]
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def search(self, units, at: int):
        """For every suffix of ``units``: its longest match (``depth`` at most), the range of that, and the range at its depth ``at``.

        ``at`` has a depth for each suffix; a suffix that matches less has an empty range there.
        """
        import numpy as np

        n = len(units)
        padded = np.append(units, 0)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        length, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, ahead = np.flatnonzero(units > 0), 0
        while live.size and ahead < self.depth:
            wanted = padded[live + ahead]
            a = self._narrowed(low[live], high[live], ahead, wanted, False)
            b = self._narrowed(a, high[live], ahead, wanted, True)
            more = (b > a) & (wanted > 0)
            live = live[more]
            ahead += 1
            low[live], high[live], length[live] = a[more], b[more], ahead
            exact = live[at[live] == ahead]
            first[exact], last[exact] = low[exact], high[exact]
        return length, low, high, first, last


class Benchmark:
    """Items of one block: their words in a row, with an end after each item."""

    def __init__(self, ids: list, texts: list[bytes], window: int) -> None:
        import numpy as np

        self.words, item = words_of(texts)
        self.names = sorted({"" if i is None else i for i in ids})
        place = {name: n for n, name in enumerate(self.names)}
        named = np.array([place["" if i is None else i] for i in ids], np.int64)
        counts = np.bincount(item, minlength=len(ids)).astype(np.int64)
        self.slots = np.arange(len(item)) + item  # of a word in the row of units
        size = len(item) + len(ids)
        ends = np.cumsum(counts + 1) - 1
        self.item, self.start, self.window = (np.zeros(size, np.int64) for _ in range(3))
        self.item[self.slots] = named[item]
        self.start[self.slots] = np.arange(len(item)) - (np.cumsum(counts) - counts)[item]
        left = ends[item] - self.slots  # words from here to the end of the item
        wide = np.minimum(window, counts)[item]
        self.window[self.slots] = np.where(left >= wide, wide, 0)

    def units(self, vocabulary):
        """The row of units in a shard's numbers; 0 for words that the shard lacks and after items."""
        import numpy as np
        import pyarrow.compute as pc

        out = np.zeros(len(self.item), np.int64)
        out[self.slots] = pc.fill_null(pc.index_in(self.words, value_set=vocabulary), -1).to_numpy() + 1
        return out


class _Blocks:
    """The blocks of the benchmark in the shared folder; a single one is kept."""

    def __init__(self, folder: str, window: int, block_words: int) -> None:
        self.folder, self.window, self.block_words, self.kept = folder, window, block_words, None

    def _read(self) -> Iterator[Benchmark]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        ids, texts, words = [], [], 0
        for batch in ds.dataset(root, filesystem=files, format="parquet").to_batches(columns=["item", "text", "n"], batch_size=4096, batch_readahead=1, fragment_readahead=1):
            for item, text, n in zip(batch.column("item").to_pylist(), texts_of(batch.column("text")), batch.column("n").to_pylist()):
                if ids and words + n > self.block_words:
                    yield Benchmark(ids, texts, self.window)
                    ids, texts, words = [], [], 0
                ids.append(item)
                texts.append(text)
                words += n
        if ids:
            yield Benchmark(ids, texts, self.window)

    def __iter__(self) -> Iterator[Benchmark]:
        if self.kept is not None:
            yield self.kept
            return
        count, block = 0, None
        for block in self._read():
            count += 1
            yield block
        if count == 1:
            self.kept = block


def _item_words():
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for block in blocks_of(batches, BLOCK_BYTES):
            _, item = words_of(texts_of(block.column("text")))
            counts = np.bincount(item, minlength=block.num_rows)
            yield from block.append_column("n", pa.array(counts.astype(np.int64))).filter(pa.array(counts > 0)).to_batches()

    return run


def _stored(benchmark: DataFrame) -> tuple[str, int]:
    """The folder of the items that have words, and the words of the longest."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    in_small_batches(items).mapInArrow(_item_words(), "item string, text string, n long").write.parquet(folder)
    longest = benchmark.sparkSession.read.schema("item string, text string, n long").parquet(folder).agg(F.max("n")).first()[0]
    return folder, longest or 0


class _Shard:
    """The documents of a block of text: units of all of them, each document closed by a 0."""

    def __init__(self, texts: list[bytes]) -> None:
        import numpy as np

        words, row = words_of(texts)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
        slots = np.arange(len(row)) + row
        self.units = np.zeros(len(row) + len(texts), np.int32)
        self.units[slots] = coded.indices.to_numpy() + 1
        self.row = np.repeat(np.arange(len(texts)), self.counts + 1)
        self.first = np.cumsum(self.counts + 1) - self.counts - 1  # slot of a document's first word

    def arrays(self, depth: int) -> Iterator[tuple[int, SuffixArray]]:
        """Suffix arrays of at most ``SHARD_WORDS`` starts, each with the words after them that matches reach into."""
        for begin in range(0, len(self.units), SHARD_WORDS):
            yield begin, SuffixArray(self.units[begin : begin + SHARD_WORDS + max(0, depth - 1)], depth)


def _spread(first, last):
    """All numbers of the ranges, and the number of the range of each."""
    import numpy as np

    sizes = last - first
    which = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes), which


def _hits(shard: _Shard, blocks: _Blocks, depth: int):
    """Whether each unit is hit, and the items of each row that has some."""
    import numpy as np

    edges = np.zeros(len(shard.units) + 1, np.int64)
    items: dict[int, set[str]] = {}
    arrays = list(shard.arrays(depth)) if len(shard.units) <= SHARD_WORDS else None
    for block in blocks:
        units = block.units(shard.vocabulary)
        for begin, array in arrays or shard.arrays(depth):
            _, _, _, first, last = array.search(units, block.window)
            found = np.flatnonzero(last > first)
            if not len(found):
                continue
            # equal windows of several items have one range
            ranges, same = np.unique(first[found] * (depth + 1) + block.window[found], return_inverse=True)
            lows, wide = ranges // (depth + 1), ranges % (depth + 1)
            highs = np.zeros(len(ranges), np.int64)
            highs[same] = last[found]
            places, which = _spread(lows, highs)
            slots = array.order[places] + begin
            np.add.at(edges, slots, 1)
            np.add.at(edges, slots + wide[which], -1)
            pairs = np.unique(shard.row[slots] * len(ranges) + which)
            of_range: list[set] = [set() for _ in ranges]
            for n, item in zip(same.tolist(), block.item[found].tolist()):
                of_range[n].add(block.names[item])
            for pair in pairs.tolist():
                items.setdefault(pair // len(ranges), set()).update(of_range[pair % len(ranges)])
    return np.cumsum(edges[:-1]) > 0, items


def _marked(folder: str, depth: int, window: int, rest: list[str]):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        blocks = _Blocks(folder, window, ITEM_WORDS)
        for block in blocks_of(batches, BLOCK_BYTES):
            shard = _Shard(texts_of(block.column("text")))
            hit, items = _hits(shard, blocks, depth) if depth else (np.zeros(len(shard.units), bool), {})
            n_hit = np.bincount(shard.row[hit], minlength=block.num_rows).astype(np.int64)
            named = [",".join(sorted(items.get(i, ()))) for i in range(block.num_rows)]
            out = block.select(rest)
            for name, column in (
                ("n_words", pa.array(shard.counts)), ("n_hit", pa.array(n_hit)),
                ("n_items", pa.array([len(items.get(i, ())) for i in range(block.num_rows)], pa.int64())),
                ("items_sha256", pa.array([hashlib.sha256(n.encode()).hexdigest() for n in named], pa.string())), ("contaminated", pa.array(n_hit > 0)),
            ):
                out = out.append_column(name, column)
            yield from out.to_batches()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and n_words, n_hit, n_items, items_sha256, contaminated."""
    folder, longest = _stored(benchmark)
    kept = in_small_batches(docs).select("text", *[F.col(c).alias(f"keep_{c}") for c in keep])
    rest = [f for f in kept.schema if f.name != "text"]
    more = [StructField(n, LongType()) for n in ("n_words", "n_hit", "n_items")]
    schema = StructType([*rest, *more, StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())])
    marked = kept.mapInArrow(_marked(folder, min(window, longest), window, [f.name for f in rest]), schema)
    return marked.select(*[F.col(f"keep_{c}").alias(c) for c in keep], *[f.name for f in schema if f not in rest])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no window hits, with all their columns."""
    packed = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    return contamination(packed, benchmark, ("document",), window).where("not contaminated").select("document.*")


def _longest(folder: str, depth: int, window: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        blocks = _Blocks(folder, window, ITEM_WORDS)
        for block in blocks_of(batches, BLOCK_BYTES):
            shard, ids = _Shard(texts_of(block.column("text"))), block.column("doc_id").combine_chunks()
            for tests in blocks:
                units = tests.units(shard.vocabulary)
                for begin, array in shard.arrays(depth):
                    length, low, high, _, _ = array.search(units, tests.window)
                    found = np.flatnonzero((tests.window > 0) & (length >= tests.window))
                    for part in np.array_split(found, max(1, int((high - low)[found].sum()) >> 16)):
                        places, which = _spread(low[part], high[part])
                        slots, own = array.order[places] + begin, part[which]
                        row = shard.row[slots]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.array(tests.names, object)[tests.item[own]], pa.string()), pa.array(tests.start[own]), pa.array(length[own]),
                            ids.take(pa.array(row)), pa.array(slots - shard.first[row]),
                        ], ["item_id", "start", "length", "doc_id", "position"])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every suffix of every item that matches at least a window: its longest verbatim match, and all places of that.

    item_id (string), start (word of the item), length (words), doc_id, position (word of the document).
    """
    folder, longest = _stored(benchmark)
    schema = StructType([
        StructField("item_id", StringType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("position", LongType()),
    ])
    if not longest:
        return docs.sparkSession.createDataFrame([], schema)
    found = materialize(in_small_batches(docs.select("text", "doc_id")).mapInArrow(_longest(folder, longest, window), schema), "matches")
    best = found.groupBy("item_id", "start").agg(F.max("length").alias("length"))
    # an item that two texts share an id and a start with may be found twice at a place
    return found.join(best, ["item_id", "start", "length"], "left_semi").distinct()
