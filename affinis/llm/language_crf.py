"""Language ID with a linear-chain conditional random field over words.

Each word has features: itself (the learned lexicon), its first and last two and three bytes
(affixes), and its byte trigrams with the word's edges, all hashed into one table of weights per
language. Learned transition weights tie neighbouring words together. The forward-backward
procedure gives each word of a text its probabilities; a text's are their mean, so a text that
switches languages gets the one most of its words are in, and the share as score.

Labels are learned from at most ``SAMPLE`` documents of each language, those of the least hash of
doc_id. Their words are cut into runs and dealt into sequences that switch languages, so that the
transitions are learned from switches as well. Prediction reads the text alone, and all of it.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text
when there is nothing to learn from; repeated rows are predicted each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from affinis.llm.common import blocks_of, held_out, in_small_batches, least_hashed, materialize, texts_of
from affinis.llm.hashing import BYTE_VALUES, LETTERS, Rolling, joined, runs

#: The most documents of each language that the model is fitted on, and bytes of text of them all.
SAMPLE, SAMPLE_BYTES = 250, 6 << 20
TABLE_BITS = 18
UNKNOWN = "und"
BLOCK_BYTES, PART_BYTES = 4 << 20, 1 << 17


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words of all texts: ids, where each word's ids start, and each word's text."""
    data, starts = joined([t.decode("utf-8", "replace").lower().encode() for t in texts])
    first, end = runs(LETTERS[data])
    text = np.searchsorted(starts, first, side="right") - 1
    rolling = Rolling(BYTE_VALUES[data])
    size = end - first
    # trigrams that lie over a word's bytes; its neighbours on both sides count as its edges
    edged = np.where(LETTERS[data], BYTE_VALUES[data], np.uint64(0))
    three = Rolling(np.concatenate(([0], edged, [0])).astype(np.uint64)).windows(3)  # three[i] is centred on byte i
    per_word = size + 5
    begin = np.cumsum(per_word) - per_word
    ids = np.empty(int(per_word.sum()), np.uint64)
    inner = np.ones(len(ids), bool)
    for slot, (a, b) in enumerate(
        ((first, end), (first, np.minimum(first + 2, end)), (first, np.minimum(first + 3, end)), (np.maximum(end - 2, first), end), (np.maximum(end - 3, first), end))
    ):
        ids[begin + slot] = rolling.of(a, b) ^ np.uint64(slot + 1)
        inner[begin + slot] = False
    ids[inner] = three[LETTERS[data]]
    return (ids * np.uint64(_SPREAD)) >> np.uint64(64 - TABLE_BITS), begin, text


_SPREAD = 0x9E3779B97F4A7C15


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


class Field:
    """The model: emission weights by feature and language, and transition weights."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.weights = np.zeros((1 << TABLE_BITS, n), np.float32)
        self.moves = np.zeros((n, n))

    def emissions(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.weights[ids], begin, axis=0)

    def marginals(self, emissions: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each word's language by forward-backward, for sequences laid end to end.

        Also the expected number of each transition, summed. All sequences advance together, the
        longest first, so that step t works on those that have a word t. ``emissions`` is used up.
        """
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        scores = emissions
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        moves = np.exp(self.moves - self.moves.max()).astype(np.float32)
        steps = int(sizes[0]) if len(sizes) else 0
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        ahead = np.empty_like(scores)
        for t in range(steps):
            at = starts[: alive[t]] + t
            a = scores[at] if t == 0 else (a[: alive[t]] @ moves) * scores[at]
            a = a / a.sum(1, keepdims=True)
            ahead[at] = a
        pairs = np.zeros_like(self.moves)
        for t in range(steps - 1, -1, -1):
            at = starts[: alive[t]] + t
            back = np.ones((alive[t], scores.shape[1]), np.float32)
            if t + 1 < steps and alive[t + 1]:
                onward = scores[at[: alive[t + 1]] + 1] * later
                back[: alive[t + 1]] = onward @ moves.T
                if self.counting:
                    joint = ahead[at[: alive[t + 1]]][:, :, None] * moves * onward[:, None, :]
                    pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            later = back / back.sum(1, keepdims=True)
            both = ahead[at] * later
            ahead[at] = both / both.sum(1, keepdims=True)  # of no more use to earlier steps
        return ahead, pairs

    counting = False

    def fit(self, sequences: list[tuple], rounds: int = 4, batch: int = 32, rate: float = 0.2) -> None:
        """Adagrad on the log-likelihood; a sequence has ids, begin (of its words) and labels."""
        self.counting = True
        dice = np.random.default_rng(5)
        n = len(self.languages)
        sums, move_sums = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(rounds):
            order = dice.permutation(len(sequences))
            for at in range(0, len(order), batch):
                part = [sequences[i] for i in order[at : at + batch]]
                ids = np.concatenate([p[0] for p in part])
                shifts = np.cumsum([0, *(len(p[0]) for p in part)])
                begin = np.concatenate([p[1] + s for p, s in zip(part, shifts)])
                labels = np.concatenate([p[2] for p in part])
                sizes = np.array([len(p[1]) for p in part])
                starts = np.cumsum(sizes) - sizes
                found, pairs = self.marginals(self.emissions(ids, begin), starts, sizes)
                miss = found.astype(np.float64)
                miss[np.arange(len(labels)), labels] -= 1
                miss /= len(labels)
                word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
                used, back = np.unique(ids, return_inverse=True)
                step = np.stack([np.bincount(back, miss[word, k], len(used)) for k in range(n)], 1) + 1e-7 * self.weights[used]
                sums[used] += step**2
                self.weights[used] -= rate * step / np.sqrt(sums[used])
                same = np.ones(len(labels), bool)
                same[starts] = False
                follow = np.flatnonzero(same)
                np.subtract.at(pairs, (labels[follow - 1], labels[follow]), 1)
                pairs /= len(labels)
                move_sums += pairs**2
                self.moves -= rate * pairs / np.sqrt(move_sums)
        self.counting = False


def switched(texts: list[bytes], labels: np.ndarray, words: int = 120) -> list[tuple]:
    """Training sequences of about ``words`` words: runs of 4 to 60 words of the texts, dealt at random."""
    dice = np.random.default_rng(3)
    cuts = []
    for start in range(0, len(texts), 64):
        ids, begin, text = features(texts[start : start + 64])
        ends = np.append(begin, len(ids))
        at = 0
        while at < len(begin):
            to = min(at + int(dice.integers(4, 61)), int(np.searchsorted(text, text[at], side="right")))
            cuts.append((ids[ends[at] : ends[to]], begin[at:to] - begin[at], np.full(to - at, labels[start + text[at]])))
            at = to
    sequences, held = [], []
    for i in dice.permutation(len(cuts)):
        held.append(cuts[i])
        if sum(len(c[1]) for c in held) >= words or i == len(cuts) - 1:
            shifts = np.cumsum([0, *(len(c[0]) for c in held)])
            sequences.append((np.concatenate([c[0] for c in held]), np.concatenate([c[1] + s for c, s in zip(held, shifts)]), np.concatenate([c[2] for c in held])))
            held = []
    return sequences


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field | None:
    """The field learned from the documents that are not held out; None if none has a language and a letter.

    The driver gets at most ``sample`` documents of each language and, of those, the first (by
    hash) that together have ``sample_bytes`` of text. Chosen texts are used whole.
    """
    known = docs.select("doc_id", "lang", F.octet_length("text").alias("n")).where(
        F.col("lang").isNotNull() & (F.col("n") > 0) & ~held_out(F.col("doc_id"))
    )
    least = materialize(least_hashed(known, "lang", sample), "language-sample")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("place", "lang"))
    chosen = least.withColumn("total", total).where((F.col("total") <= sample_bytes) | (F.col("place") == 1)).select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null").orderBy("doc_id", "lang", "text").collect()
    rows = [(r.lang, r.text.encode()) for r in rows]
    rows = [(lang, text) for lang, text in rows if has_letter(text)]
    if not rows:
        return None
    field = Field(sorted({lang for lang, _ in rows}))
    number = {lang: i for i, lang in enumerate(field.languages)}
    field.fit(switched([t for _, t in rows], np.array([number[lang] for lang, _ in rows])))
    return field


def _predicted(field: Field | None, rest: list[str]):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for block in blocks_of(batches, BLOCK_BYTES):
            texts = texts_of(block.column("text"))
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if field is not None:
                emissions, owner, start = [], [], 0
                # features are made in parts, so that a long block does not hold all of them at once
                sizes = np.cumsum([len(t) for t in texts]) // PART_BYTES
                for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                    ids, begin, text = features([texts[i] for i in part])
                    emissions.append(field.emissions(ids, begin))
                    owner.append(text + start)
                    start += len(part)
                emissions, owner = np.concatenate(emissions), np.concatenate(owner).astype(np.int32)
                present, first, sizes = np.unique(owner, return_index=True, return_counts=True)
                found, _ = field.marginals(emissions, first, sizes)
                if len(present):
                    mean = np.add.reduceat(found, first, axis=0, dtype=np.float64) / sizes[:, None]
                    best = mean.argmax(1)
                    names[present] = np.array(field.languages, object)[best]
                    scores[present] = np.clip(mean[np.arange(len(best)), best], 0, 1)
                for i, text in enumerate(texts):  # words of longer characters need not have a letter
                    if names[i] != UNKNOWN and not text.isascii() and not has_letter(text):
                        names[i], scores[i] = UNKNOWN, 0.0
            out = block.select(rest).append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores))
            yield from out.to_batches()

    return run


def predicted(docs: DataFrame, field: Field | None, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``lang_pred`` and ``score``."""
    rest = [f for f in in_small_batches(docs).schema if keep_text or f.name != "text"]
    schema = StructType([*rest, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_predicted(field, [f.name for f in rest]), schema)


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    out = predicted(docs.select("doc_id", "text"), fit(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is in some language; those predicted ``und`` go."""
    packed = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    return predicted(packed, fit(docs, sample)).where(F.col("lang_pred") != UNKNOWN).select("document.*")
