"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first four and five bytes, hashed to 32 bits; a text has a term
or not. The terms that tell the labels apart best in the training rows are kept. The score is

    sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j)

so that a pair of terms can count for more, or less, than its members do alone. Labels are learned from at
most ``SAMPLE`` rows of each label, those of the least hash of doc_id; the bias is set to the share
of label 1 among all training rows. Texts are scored whole.

Defined results: a null or empty text has no terms and gets the score of the bias; without
training rows of both labels every score is the share of label 1 (0 without any); null labels
are not learned from; of several labels of a document the largest counts; repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from affinis.llm.common import blocks_of, held_out, in_small_batches, least_hashed, materialize, texts_of
from affinis.llm.hashing import ALNUM, BYTE_VALUES, Rolling, joined, runs

#: The most labelled rows of each label that the model is fitted on.
SAMPLE = 8_000
TERMS, FACTORS = 4_096, 8
#: A term is kept if its log-likelihood ratio reaches this, and enough rows have it.
LEAST_RATIO, LEAST_ROWS = 12.0, 3
BLOCK_BYTES = 2 << 20


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of all terms of all texts; repeats included."""
    data, starts = joined([t.decode("utf-8", "replace").lower().encode() for t in texts])
    first, end = runs(ALNUM[data])
    text = np.searchsorted(starts, first, side="right") - 1
    rolling = Rolling(BYTE_VALUES[data])
    found = [(text, rolling.of(first, end) ^ np.uint64(1))]
    for length in (4, 5):
        long = end - first > length
        found.append((text[long], rolling.of(first[long], first[long] + length) ^ np.uint64(length)))
    return np.concatenate([t for t, _ in found]), np.concatenate([h for _, h in found]) >> np.uint64(32)


def _counts(batches: Iterable) -> Iterator:
    """How many texts of each label have a term."""
    import pyarrow as pa

    for block in blocks_of(batches, BLOCK_BYTES):
        toxic = block.column("toxic").to_numpy()
        text, term = terms(texts_of(block.column("text")))
        pairs = np.unique((term << np.uint64(32)) | text.astype(np.uint64))
        term, label = pairs >> np.uint64(32), toxic[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        distinct, place = np.unique(term, return_inverse=True)
        ones = np.bincount(place, label, len(distinct)).astype(np.int64)
        both = np.bincount(place, minlength=len(distinct)).astype(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(ones), pa.array(both - ones)], ["term", "ones", "zeros"])
        yield from (out.slice(i, 10_000) for i in range(0, out.num_rows, 10_000))


class Lookup:
    """Places of kept terms (sorted); most other terms fail on a bitmap of their upper bits."""

    def __init__(self, kept: np.ndarray) -> None:
        self.kept = kept.astype(np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.kept >> np.uint64(10)).astype(np.int64)] = True

    def of(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place) for the terms that are kept, in order of the text."""
        some = self.maybe[(term >> np.uint64(10)).astype(np.int64)]
        text, term = text[some], term[some]
        if not len(self.kept):
            return text[:0], text[:0]
        place = np.minimum(np.searchsorted(self.kept, term), len(self.kept) - 1)
        hit = self.kept[place] == term
        pairs = np.unique(text[hit] * len(self.kept) + place[hit])
        return pairs // len(self.kept), pairs % len(self.kept)


class Machine:
    """The model; fitted by Adagrad on the logistic loss."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7) -> None:
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, factors))

    def margin(self, n: int, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        total = self.bias + np.bincount(text, self.w[place], n)
        for f in range(self.v.shape[1]):
            v = self.v[place, f]
            total += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return total

    def fit(self, n: int, text: np.ndarray, place: np.ndarray, label: np.ndarray, rounds: int = 30, batch: int = 256, rate: float = 0.1, decay: float = 1e-5) -> None:
        order = np.random.default_rng(11)
        starts = np.searchsorted(text, np.arange(n + 1))
        sums = [1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)]
        for _ in range(rounds):
            shuffled = order.permutation(n)
            for at in range(0, n, batch):
                rows = shuffled[at : at + batch]
                sizes = starts[rows + 1] - starts[rows]
                index = np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                own, where = np.repeat(np.arange(len(rows)), sizes), place[index]
                miss = 1 / (1 + np.exp(-np.clip(self.margin(len(rows), own, where), -30, 30))) - label[rows]
                v = self.v[where]
                summed = np.zeros((len(rows), v.shape[1]))
                np.add.at(summed, own, v)
                used, back = np.unique(where, return_inverse=True)
                dw = np.bincount(back, miss[own], len(used)) / len(rows) + decay * self.w[used]
                dv = np.zeros((len(used), v.shape[1]))
                np.add.at(dv, back, miss[own][:, None] * (summed[own] - v) / len(rows))
                dv += decay * self.v[used]
                db = miss.mean()
                sums[0] += db**2
                sums[1][used] += dw**2
                sums[2][used] += dv**2
                self.bias -= rate * db / np.sqrt(sums[0])
                self.w[used] -= rate * dw / np.sqrt(sums[1][used])
                self.v[used] -= rate * dv / np.sqrt(sums[2][used])


def _present(kept: np.ndarray):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lookup = Lookup(kept)
        for block in blocks_of(batches, BLOCK_BYTES):
            text, place = lookup.of(*terms(texts_of(block.column("text"))))
            ends = np.searchsorted(text, np.arange(block.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("toxic").combine_chunks(), lists], ["toxic", "places"])

    return run


def ratio(all_ones: int, all_zeros: int) -> Column:
    """Log-likelihood ratio of a term's presence (``ones`` and ``zeros`` rows have it) against the label."""
    ones, zeros, n = F.col("ones"), F.col("zeros"), all_ones + all_zeros
    has = ones + zeros

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (
        part(ones, has * all_ones / n) + part(zeros, has * all_zeros / n)
        + part(all_ones - ones, (n - has) * all_ones / n) + part(all_zeros - zeros, (n - has) * all_zeros / n)
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Machine]:
    """The kept terms and the machine, from the rows that are not held out.

    The driver gets at most ``TERMS`` terms, and the kept terms of at most ``2 * sample`` rows.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = materialize(marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic")), "toxic-labels")
    everyone, ones = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    machine = Machine(0)
    share = ones / everyone if everyone else 0.0
    machine.bias = float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)))
    if not 0 < share < 1:
        return np.empty(0, np.uint64), machine
    chosen = least_hashed(marked, "toxic", sample).select("doc_id", "toxic")
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    n, n_ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_ones < n:
        return np.empty(0, np.uint64), machine
    counts = rows.mapInArrow(_counts, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    telling = counts.where(F.col("ones") + F.col("zeros") >= LEAST_ROWS).withColumn("ratio", ratio(n_ones, n - n_ones)).where(F.col("ratio") >= LEAST_RATIO)
    kept = np.array(sorted(r.term for r in telling.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()), np.uint64)
    found = rows.mapInArrow(_present(kept), "toxic long, places array<int>").toArrow()
    lists = found.column("places").combine_chunks()
    text = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    machine = Machine(len(kept))
    machine.bias = float(np.log(n_ones / (n - n_ones)))
    machine.fit(n, text, lists.flatten().to_numpy().astype(np.int64), found.column("toxic").to_numpy().astype(float))
    machine.bias += float(np.log(share / (1 - share)) - np.log(n_ones / (n - n_ones)))
    return kept, machine


def _scored(kept: np.ndarray, machine: Machine, rest: list[str]):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lookup = Lookup(kept)
        for block in blocks_of(batches, BLOCK_BYTES):
            n = block.num_rows
            text, place = lookup.of(*terms(texts_of(block.column("text"))))
            score = 1 / (1 + np.exp(-np.clip(machine.margin(n, text, place), -500, 500)))
            yield from block.select(rest).append_column("score", pa.array(score)).to_batches()

    return run


def scored(docs: DataFrame, kept: np.ndarray, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    rest = [f for f in docs.schema if f.name != "text"]
    schema = StructType([*rest, StructField("score", DoubleType())])
    return docs.mapInArrow(_scored(kept, machine, [f.name for f in rest]), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    kept, machine = fit(in_small_batches(docs), labels, sample)
    out = scored(docs.select("doc_id", "text"), kept, machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
