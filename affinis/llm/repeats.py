"""Windows that also occur earlier: the search that both substring operators share.

A text is a sequence of units (words or bytes). A window, ``length`` units of one text, is
repeated if the same units also start earlier. All windows are far too many to shuffle. Instead:

1. Anchors. Of the short grams inside a window the first of the least hash is its anchor, so equal
   windows have equal anchors at the same place; about ``2 / (length - gram + 2)`` of all places
   are anchors. An anchor's context is what its windows cover; each window has one anchor. Each task asks about its
   anchors, once for each context in a block: (gram, context, first place), packed by bucket of
   the gram. Texts are not shuffled.
2. Answers. A bucket tells each chunk of documents, for contexts it asked about that matter, the first place
   of the context and whether its gram has other contexts too.
3. A second pass over the chunks. A context that also occurs earlier is covered by windows that do. A
   context that is the first of its kind, but whose gram has others, may still share some
   of its windows: its units go, as a piece, to the shard of its gram.
4. Shards compare pieces exactly, with the operator's suffix structure, and return the windows
   that also occur earlier.
5. A last pass takes the covered units out of each text.

Chunks are runs of rows of a file; what a chunk is told is a folder in the shared storage, which any
task that meets the chunk loads. A gram with very many contexts in one block (a line that a third
of all texts have, with other text around it) is hot: it is only reported. A gram with very many
contexts over all blocks is hot as well. The windows of hot grams go to shards
one by one, dealt by their own hash, and only the first of a block's equal ones.

Hashes have 64 bits: two different contexts of one gram are taken for equal with probability
2**-64. Pieces are compared unit by unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import blocks_of, in_small_batches, materialize, scratch_path, texts_of
from affinis.llm.hashing import BYTE_VALUES, Rolling, joined, mixed, runs

CHUNK_ROWS = 8192
#: Text of a bucket's share of anchors; pieces of a shard.
BUCKET_BYTES, SHARD_PIECES = 16 << 20, 20_000
#: Contexts of one gram in a block that make it hot.
HOT_CONTEXTS = 32
#: Contexts of one gram over all blocks that make it hot: half of a shard, which a gram's pieces meet in.
HOT_IN_ALL = SHARD_PIECES // 2
NO_ID = 2**63 - 1  # a missing doc_id comes after all others
SPAN = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


@dataclass(frozen=True)
class Plan:
    """What is a unit, how long is a window, and what counts as earlier."""

    words: bool
    length: int
    gram: int
    #: True: an earlier start in the same document counts as well as a smaller doc_id
    within: bool
    classes: Callable
    block_bytes: int

    @property
    def asked(self) -> np.dtype:
        own = [("pos", "<i4")] if self.within else []
        return np.dtype([("gram", "<u4"), ("many", "<u1"), ("context", "<u8"), ("doc", "<i8"), *own])

    @property
    def answered(self) -> np.dtype:
        """``kind``: 1 the gram has other contexts, 2 the gram is hot (then ``context`` is the gram)."""
        own = [("pos", "<i4")] if self.within else []
        return np.dtype([("context", "<u8"), ("kind", "<u1"), ("doc", "<i8"), *own])


class Units:
    """The units of all texts of a block: their hashes, and where each text's units start and end."""

    def __init__(self, texts: list[bytes], words: bool) -> None:
        data, starts = joined(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        if words:
            space = ((data >= 9) & (data <= 13)) | (data == 32)
            self.first, self.last = runs(~space)
            self.values = Rolling(BYTE_VALUES[data]).of(self.first, self.last)
            self.starts = np.searchsorted(self.first, starts)
            self.ends = np.searchsorted(self.first, starts + sizes)
        else:
            self.values, self.starts, self.ends = BYTE_VALUES[data], starts, starts + sizes
        self.data, self.words = data, words

    def contents(self, starts: np.ndarray, ends: np.ndarray):
        """The bytes of ranges of units as an Arrow column; between words, what the text has."""
        import pyarrow as pa

        if self.words and len(starts):
            starts, ends = self.first[starts], self.last[ends - 1]
        sizes = ends - starts
        to = np.cumsum(sizes)
        data = self.data[np.repeat(starts - to + sizes, sizes) + np.arange(sizes.sum())]
        offsets = np.append(0, to).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The extreme of each ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


class Anchors:
    """Anchors of a block, in order of their place: text, place, context (start, end), and hashes."""

    def __init__(self, units: Units, plan: Plan) -> None:
        length, gram = plan.length, plan.gram
        width = length - gram + 1
        n = len(units.values)
        self.rolling = Rolling(units.values)
        self.at = np.empty(0, np.int64)
        if n >= length:
            grams = self.rolling.windows(gram)
            top = np.uint64(2**64 - 1)
            grams = np.clip(grams, np.uint64(1), top)
            least = _extreme(grams, width, np.minimum)  # of the window that starts here
            whole = np.zeros(len(least) + 1, np.int64)  # windows inside one text
            long = units.ends - units.starts >= length
            np.add.at(whole, units.starts[long], 1)
            np.add.at(whole, units.ends[long] - length + 1, -1)
            least = np.where(np.cumsum(whole[:-1]) > 0, least, np.uint64(0))
            padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
            self.at = np.flatnonzero(_extreme(padded, width, np.maximum)[: len(grams)] == grams)
            self.grams = grams[self.at]
        else:
            self.grams = np.empty(0, np.uint64)
        # texts without units share their start with the next one: the last that starts here owns it
        self.text = np.searchsorted(units.starts, self.at, side="right") - 1
        if len(self.at):
            low = np.maximum(units.starts[self.text], self.at - (width - 1))
            high = np.minimum(units.ends[self.text] - length, self.at)
            self._cut(low, high, width)
            own = low <= high  # of equal grams in reach of each other, a later one may own no window
            self.at, self.grams, self.text = self.at[own], self.grams[own], self.text[own]
            self.start, self.end = low[own], high[own] + length
        else:
            self.start = self.end = self.at
        whole = self.rolling.of(self.start, self.end)
        shape = ((self.at - self.start) * 4096 + (self.end - self.at)).astype(np.uint64)
        self.contexts = np.maximum(mixed(whole ^ mixed(shape)), np.uint64(1))
        self.places = self.at - units.starts[self.text] if len(self.at) else self.at

    def _cut(self, low: np.ndarray, high: np.ndarray, width: int) -> None:
        """Narrows the window starts of each place to those it is the anchor of."""
        for step in range(1, width):
            # another place within reach that has a smaller gram, or an equal one further left, owns the windows of both
            near = self.at[step:] - self.at[:-step] < width
            if not near.any():
                break
            left = np.flatnonzero(near)
            right = left + step
            loses = self.grams[right] >= self.grams[left]
            low[right[loses]] = np.maximum(low[right[loses]], self.at[left[loses]] + 1)
            high[left[~loses]] = np.minimum(high[left[~loses]], self.at[right[~loses]] - width)


def _pieces_of(batches: Iterable, block_bytes: int) -> Iterator:
    """Blocks of rows of one chunk."""
    for block in blocks_of(batches, block_bytes):
        chunks = block.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1), len(chunks)]
        for a, b in zip(cuts, cuts[1:]):
            part = block.slice(a, b - a)
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
            yield int(chunks[a]), part, ids


def _packed(groups: Iterable, names: list[str], kinds: list) -> object:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*groups), kinds)], names)


def _split(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), records[a:b].tobytes()


def _place_order(plan: Plan, doc: np.ndarray, pos: np.ndarray | None, *keys: np.ndarray) -> np.ndarray:
    """An order by ``keys`` (the last counts most), then place."""
    return np.lexsort((pos, doc, *keys) if plan.within else (doc, *keys))


def _asks(plan: Plan, buckets: int):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for chunk, block, ids in _pieces_of(batches, plan.block_bytes):
            anchors = Anchors(Units(texts_of(block.column("text")), plan.words), plan)
            if not len(anchors.at):
                continue
            doc = ids[anchors.text]
            order = _place_order(plan, doc, anchors.places, anchors.contexts, anchors.grams)
            grams, contexts = anchors.grams[order], anchors.contexts[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = contexts[1:] != contexts[:-1]
            keep = np.flatnonzero(fresh)
            many = np.diff(np.append(keep, len(order))) > 1
            grams, contexts, order = grams[keep], contexts[keep], order[keep]
            records = np.zeros(len(keep), plan.asked)
            records["gram"], records["many"], records["context"], records["doc"] = grams & np.uint64(0xFFFFFFFF), many, contexts, doc[order]
            if plan.within:
                records["pos"] = anchors.places[order]
            bucket = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            # a gram with many contexts is only reported, by a context of 0
            first = np.ones(len(grams), bool)
            first[1:] = grams[1:] != grams[:-1]
            at = np.flatnonzero(first)
            counts = np.diff(np.append(at, len(grams)))
            hot = np.repeat(counts >= HOT_CONTEXTS, counts)
            records["context"][hot] = 0
            keep = ~hot | first
            rows = [(b, chunk, payload) for b, payload in _split(bucket[keep], records[keep])]
            yield _packed(rows, ["bucket", "chunk", "payload"], [pa.int32(), pa.int64(), pa.binary()])

    return run


def _answers(plan: Plan):
    def run(key, table):
        import pyarrow as pa

        payloads = table.column("payload").to_pylist()
        records = np.frombuffer(b"".join(payloads), plan.asked)
        chunks = np.repeat(table.column("chunk").to_numpy(), [len(p) // plan.asked.itemsize for p in payloads])
        order = _place_order(plan, records["doc"], records["pos"] if plan.within else None, records["context"], records["gram"])
        gram, context, chunks, records = records["gram"][order], records["context"][order], chunks[order], records[order]
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new_context = new_gram | np.append(True, context[1:] != context[:-1])
        of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
        first = np.flatnonzero(new_context)
        contexts = np.bincount(of_gram[first])  # of each gram
        hot = contexts >= HOT_IN_ALL
        hot[of_gram[context == 0]] = True
        several = (np.bincount(of_context) > 1) | (np.bincount(of_context, records["many"]) > 0)
        kind = np.where(hot, 2, np.where(contexts > 1, 1, 0))[of_gram]
        told = (kind > 0) | several[of_context]
        out = np.zeros(int(told.sum()), plan.answered)
        leader = first[of_context[told]]
        bucket = np.uint64(key[0].as_py() << 32)
        out["context"] = np.where(kind[told] == 2, gram[told].astype(np.uint64) | bucket, context[told])
        out["kind"], out["doc"] = kind[told], records["doc"][leader]
        if plan.within:
            out["pos"] = records["pos"][leader]
        rows = list(_split(chunks[told], out))
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return run


def _load(folder: str, chunk: int, kind: np.dtype) -> np.ndarray:
    """What a chunk was told; nothing if it has no folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(f"{folder}/chunk={chunk}")
    if files.get_file_info(root).type != fs.FileType.Directory:
        return np.empty(0, kind)
    found = ds.dataset(root, filesystem=files, format="parquet").to_table(columns=["payload"])
    return np.frombuffer(b"".join(found.column("payload").to_pylist()), kind)


def _spans(rows: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(text), SPAN)
    out["row"], out["start"], out["end"] = rows[text], start, end
    return out


def _second_pass(plan: Plan, folder: str, buckets: int):
    """Rows of kind 0 hold spans of a chunk; rows of kind 1 are pieces, to be dealt by ``key``."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["kind", "chunk", "key", "row", "doc", "start", "content"]

        def pieces(chunk: int, hashes, row, doc, start, content) -> Iterator:
            n = len(hashes)
            columns = [np.ones(n, np.int32), np.full(n, chunk), (hashes >> np.uint64(1)).astype(np.int64), row, doc, start.astype(np.int32)]
            whole = pa.RecordBatch.from_arrays([*map(pa.array, columns), content], names)
            yield from (whole.slice(i, 5000) for i in range(0, n, 5000))

        chunk, told, hot = None, None, None
        for own, block, ids in _pieces_of(batches, plan.block_bytes):
            if own != chunk:
                chunk, told = own, _load(folder, own, plan.answered)
                hot = np.unique(told["context"][told["kind"] == 2])
                told = told[told["kind"] < 2]
                told = told[np.unique(told["context"], return_index=True)[1]]
            if not len(told) and not len(hot):
                continue
            units = Units(texts_of(block.column("text")), plan.words)
            anchors = Anchors(units, plan)
            if not len(anchors.at):
                continue
            rows, doc, base = block.column("row").to_numpy(), ids[anchors.text], units.starts[anchors.text]
            named = ((anchors.grams >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (anchors.grams & np.uint64(0xFFFFFFFF))
            is_hot = np.isin(named, hot)
            known = np.zeros(len(doc), bool)
            later, leads = known.copy(), known.copy()
            if len(told):
                found = np.minimum(np.searchsorted(told["context"], anchors.contexts), len(told) - 1)
                known = (told["context"][found] == anchors.contexts) & ~is_hot
                later = told["doc"][found] < doc
                if plan.within:
                    later |= (told["doc"][found] == doc) & (told["pos"][found] < anchors.places)
                leads = known & ~later & (told["kind"][found] == 1)
                later &= known
            spans = [_spans(rows, anchors.text[later], (anchors.start - base)[later], (anchors.end - base)[later])]
            yield from pieces(
                own, anchors.grams[leads], rows[anchors.text[leads]], doc[leads], (anchors.start - base)[leads],
                units.contents(anchors.start[leads], anchors.end[leads]),
            )
            if is_hot.any():
                single, covered = _hot_windows(plan, units, anchors, np.flatnonzero(is_hot), ids, rows)
                spans.append(covered)
                yield from pieces(own, *single)
            spans = np.concatenate(spans)
            if len(spans):
                zero = pa.array([0])
                yield pa.RecordBatch.from_arrays(
                    [zero.cast(pa.int32()), pa.array([own]), zero, zero, zero, zero.cast(pa.int32()), pa.array([spans.tobytes()], pa.binary())], names
                )

    return run


def _hot_windows(plan: Plan, units: Units, anchors: Anchors, which: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Single windows around hot anchors: those to ask about, and spans of those that the block itself has earlier."""
    text = anchors.text[which]
    low = anchors.start[which]
    counts = anchors.end[which] - plan.length - low + 1
    starts = np.unique(np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))
    text = np.searchsorted(units.starts, starts, side="right") - 1
    hashes = anchors.rolling.of(starts, starts + plan.length)
    places, doc = starts - units.starts[text], ids[text]
    order = _place_order(plan, doc, places, hashes)
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = doc[order] == doc[order][leader]
    # the leader is earlier: a smaller doc_id, or where that counts an earlier place
    later = ~same | (places[order] > places[order][leader]) if plan.within else ~same
    late, early = order[later], order[~later]
    single = hashes[early], rows[text[early]], doc[early], places[early], units.contents(starts[early], starts[early] + plan.length)
    return single, _spans(rows, text[late], places[late], places[late] + plan.length)


def repeated_windows(plan: Plan, pieces: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window start in it) of all windows of the pieces that also occur at an earlier place."""
    if plan.words:
        number: dict[bytes, int] = {}
        sequences = [np.array([number.setdefault(w, len(number)) for w in p.split()], np.int64) for p in pieces]
    else:
        sequences = [np.frombuffer(p, np.uint8).astype(np.int64) for p in pieces]
    sizes = np.array([len(s) for s in sequences], np.int64)
    begins = np.cumsum(sizes) - sizes
    rolling = Rolling(mixed(np.concatenate(sequences).astype(np.uint64) + np.uint64(1)))
    hashes = rolling.windows(plan.length)
    inside = np.zeros(len(hashes) + 1, np.int64)
    fit = sizes >= plan.length
    np.add.at(inside, begins[fit], 1)
    np.add.at(inside, begins[fit] + sizes[fit] - plan.length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    # windows that no other one can equal need no comparison; the rest form runs inside their pieces
    _, back, counts = np.unique(hashes[windows], return_inverse=True, return_counts=True)
    windows = windows[counts[back] > 1]
    if not len(windows):
        return windows, windows
    piece = np.searchsorted(begins, windows, side="right") - 1
    breaks = np.flatnonzero((np.diff(windows) > 1) | (np.diff(piece) > 0)) + 1
    heads = np.append(0, breaks)
    tails = np.append(breaks, len(windows))
    whole = np.concatenate(sequences)
    # equal runs are compared once
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(whole[windows[a] : windows[b - 1] + plan.length].tobytes(), len(distinct)) for a, b in zip(heads, tails)]
    found = plan.classes([np.frombuffer(content, np.int64) for content in distinct], plan.length)
    label = np.concatenate([found[w] for w in which])
    own_doc, own_place = doc[piece], start[piece] + windows - begins[piece]
    order = _place_order(plan, own_doc, own_place, label)
    new = np.append(True, label[order][1:] != label[order][:-1])
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = own_doc[leader] < own_doc[order]
    if plan.within:
        later |= (own_doc[leader] == own_doc[order]) & (own_place[leader] < own_place[order])
    late = order[later]
    return piece[late], (windows - begins[piece])[late]


def _shards(plan: Plan):
    def run(key, table):
        import pyarrow as pa

        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy().astype(np.int64)
        piece, window = repeated_windows(plan, table.column("content").to_pylist(), doc, start)
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        new = np.append(True, (np.diff(piece) > 0) | (np.diff(window) > 1)) if len(piece) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(piece)) - 1 if len(first) else first
        begin = start[piece[first]] + window[first]
        end = start[piece[first]] + window[last] + plan.length
        rows = list(_split(table.column("chunk").to_numpy()[piece[first]], _spans(table.column("row").to_numpy(), piece[first], begin, end)))
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return run


def _last_pass(plan: Plan, folders: list[str]):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        chunk, spans, known = None, None, None
        for own, block, _ in _pieces_of(batches, plan.block_bytes):
            if own != chunk:
                chunk, spans = own, np.concatenate([_load(f, own, SPAN) for f in folders])
                spans = spans[np.argsort(spans, order=("row", "start"))]
                known, at = np.unique(spans["row"], return_index=True)
                ranges = dict(zip(known.tolist(), zip(at, np.append(at[1:], len(spans)))))
            out = []
            for row, doc_id, text in zip(block.column("row").to_pylist(), block.column("doc_id").to_pylist(), texts_of(block.column("text"))):
                units = text.split() if plan.words else text
                kept, to, count = [], 0, 0
                for start, end in zip(*(spans[name][slice(*ranges.get(row, (0, 0)))].tolist() for name in ("start", "end"))):
                    if start > to or not count:
                        kept.append(units[to:start])
                        count += 1
                    to = max(to, end)
                kept.append(units[to:])
                rest = [w for part in kept for w in part] if plan.words else b"".join(kept)
                removed = len(units) - len(rest)
                content = b" ".join(rest) if plan.words else rest
                out.append((doc_id, len(units), removed, count, hashlib.sha256(content).hexdigest(), content))
            yield _packed(out, names, kinds)

    return run


def placed(docs: DataFrame) -> DataFrame:
    """doc_id and text with ``chunk`` and ``row``, from the place in the Parquet file; other sources are written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place)
    except AnalysisException:
        found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "repeats-documents").select("doc_id", "text", *place)
    return found.withColumn("chunk", F.xxhash64("file", F.floor(F.col("row") / CHUNK_ROWS))).drop("file")


def without_repeats(docs: DataFrame, plan: Plan, with_text: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 (and ``kept``, in UTF-8) of every row of ``docs``."""
    spark = docs.sparkSession
    texts = placed(in_small_batches(docs))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    told, local, resolved = (scratch_path(spark, f"repeats-{name}") for name in ("told", "local", "resolved"))
    asked = texts.mapInArrow(_asks(plan, buckets), "bucket int, chunk long, payload binary")
    answers = asked.groupBy("bucket").applyInArrow(_answers(plan), "chunk long, payload binary")
    answers.repartition("chunk").write.partitionBy("chunk").parquet(told)

    rows = "kind int, chunk long, key long, row long, doc long, start int, content binary"
    texts.mapInArrow(_second_pass(plan, told, buckets), rows).write.partitionBy("kind").parquet(local)
    found = spark.read.schema(rows).parquet(local)
    found.where("kind = 0").select("chunk", F.col("content").alias("payload")).repartition("chunk").write.partitionBy("chunk").parquet(f"{resolved}-own")
    pieces = found.where("kind = 1")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    compared = pieces.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(_shards(plan), "chunk long, payload binary")
    compared.repartition("chunk").write.partitionBy("chunk").parquet(f"{resolved}-shared")

    schema = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    last = _last_pass(plan, [f"{resolved}-own", f"{resolved}-shared"])
    if with_text:
        return texts.mapInArrow(last, schema)
    return texts.mapInArrow(lambda batches: (b.select(b.schema.names[:-1]) for b in last(batches)), schema.removesuffix(", kept binary"))
