"""Phrase collocations against counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from affinis.llm import collocations, queries
from tests.llm.plain import DOCS, WORDS, edge_documents, sorted_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(rows):
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            yield "und" if lang is None else lang, re.findall("[^\x20\x09]+", piece)


def plain_counts(rows, least, longest=5):
    """Counts of frequent phrases by (lang, words), and of all words by lang."""
    counts, n = Counter(), Counter()
    for lang, words in plain_pieces(rows):
        n[lang] += len(words)
        for size in range(1, longest + 1):
            for i in range(len(words) - size + 1):
                counts[lang, tuple(words[i : i + size])] += 1
    return {k: v for k, v in counts.items() if v >= least}, n


def plain_best(rows, least=100, longest=5, best=2000):
    counts, n = plain_counts(rows, least, longest)
    inside = {}
    for (lang, words), f in counts.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inside[lang, words[i : i + size]] = max(f, inside.get((lang, words[i : i + size]), 0))
    found = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and 100 * inside.get((lang, words), -1) < 100 * a:
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def made(seed, n=150):
    dice = random.Random(seed)
    fixed = [" ".join(dice.choices(WORDS, k=dice.randint(2, 7))) for _ in range(12)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(dice.randint(0, 8)):
            text += dice.choice([dice.choice(fixed), dice.choice(WORDS), "Ash ash ASH ash", "x\x00y\x1cz"]) + dice.choice([" ", " ", "\t", ". ", ", ", "\n", "!", "\r\v"])
        rows.append((text, dice.choice(["en", "en", "de", None, "und"])))
    return rows + rows[:20] + [(None, "en"), ("", "de"), (" \t\n", None), ("oak " * 4000, "fr"), ("oak elm. " * 300, "fr")]


@pytest.mark.parametrize("least,longest,best,shards,size", [(3, 5, 2000, 4, 1 << 24), (8, 5, 7, 3, 64), (2, 3, 2000, 1, 1 << 15), (5, 2, 3, 2, 1 << 16), (4, 6, 50, 4, 1 << 10), (3, 5, 2000, 3, 256)])
def test_best_equal_plain(spark, least, longest, best, shards, size):
    rows = made(least)
    clashes = ["n", "a", "l", "r", "phrase", "size", "shard", "words", "ids", "score", "rank", "doc_id"]
    docs = spark.createDataFrame([(*r, *["c"] * len(clashes)) for r in rows], "text string, lang string, " + ", ".join(f"{c} string" for c in clashes)).repartition(6)
    got = collocations.collocations(docs, least, longest, best, shards, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted_rows(got.collect()) == sorted_rows(plain_best(rows, least, longest, best))


def test_edge_documents(spark):
    rows = edge_documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted_rows(collocations.collocations(docs, 4).collect()) == sorted_rows(plain_best([r[1:3] for r in rows], 4))
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_large_products(spark):
    """Products that pass 64 bits."""
    phrases = spark.createDataFrame([("x", 2, "a b", 10**12), ("x", 1, "a", 10**12 + 1), ("x", 1, "b", 10**13)], "lang string, size int, phrase string, n long")
    totals = spark.createDataFrame([("x", 10**14 + 7)], "lang string, n long")
    (row,) = collocations.scored(phrases, totals).collect()
    assert row.score == 1000 * 10**12 * (10**14 + 7) // ((10**12 + 1) * 10**13)


def test_a_phrase_is_counted_for_one_cycle_from_its_step(spark, monkeypatch):
    """Longer phrases begin before shorter ones are complete, and a scan leaves out what is complete."""
    told = []
    scan = collocations._scan

    def watched(sent, step, shards, longest):
        told.append(step)
        return scan(sent, step, shards, longest)

    monkeypatch.setattr(collocations, "_scan", watched)
    rows = [("oak elm ash fir. " * 20, "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    corpus = collocations._corpus(docs, 4)
    assert {r.shard for r in corpus.select("shard").distinct().collect()} == {0, 1, 2, 3}
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in collocations.frequent(corpus, 100, shards=4).collect()}
    assert got == plain_counts(rows, 100)[0]
    # words reach the threshold in step 0, phrases of 4 words in step 3; those that could be longer are counted until step 7
    assert told == list(range(8))


def test_active_phrases_of_a_chunk():
    """Places that are set by chance add phrases to a scan; a phrase is active for one cycle from the step after both its parts."""
    words = pa.array(["a", "b", "c"])
    ids = np.array([-1, 0, 1, 2, 0, 1, -1, 1, 0], np.int32)

    def active(times, step, shards=2):
        found = collocations.counted("en", words, ids, np.array(times, np.uint8), step, shards, 3)
        return {(size, p): (first, n) for size, phrases, start, counts in found for p, first, n in zip(phrases.to_pylist(), start.tolist(), counts.tolist())}

    single = {(1, "a"): (0, 3), (1, "b"): (0, 3), (1, "c"): (0, 1)}
    pairs = {(2, "a b"): 2, (2, "b c"): 1, (2, "c a"): 1, (2, "b a"): 1, (3, "a b c"): 1, (3, "b c a"): 1, (3, "c a b"): 1}
    assert active([0] * 8, 0) == single
    assert active([0] * 8, 5) == {}
    assert active([1] * 8, 1) == single | {k: (1, n) for k, n in pairs.items()}
    assert active([1] * 8, 2) == {k: (1, n) for k, n in pairs.items()}
    assert active([1] * 8, 3) == {}
    assert active([3] * 8, 4) == {k: (3, n) for k, n in pairs.items()}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_best(rows)
    assert len(want) > 20
    assert sorted_rows(queries.op13_collocations(spark, sf).collect()) == sorted_rows(want)


def test_a_task_holds_few_chunks_at_a_time(spark, monkeypatch, tmp_path):
    """However many chunks a file has: row groups, which a reader takes as a whole, and what a worker gets are small."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 200)
    monkeypatch.setattr(collocations, "GROUP_BYTES", 4096)
    rows = [(" ".join(random.Random(n).choices(WORDS, k=400)) + ".", "en") for n in range(60)]
    corpus = collocations._corpus(spark.createDataFrame(rows, "text string, lang string").coalesce(1), 1)
    (file,) = corpus.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file:")).metadata
    assert groups.num_rows == 60 and max(groups.row_group(g).num_rows for g in range(groups.num_row_groups)) < 10
    seen, chunks = spark.sparkContext.accumulator(0), collocations._chunks

    def watched(batches):
        for batch in batches:
            if batch.num_rows > collocations.BATCH_CHUNKS:
                seen.add(1)
            yield from chunks([batch])

    monkeypatch.setattr(collocations, "_chunks", watched)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in collocations.frequent(corpus, 100, shards=1).collect()}
    assert got == plain_counts(rows, 100)[0]
    assert seen.value == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > collocations.BATCH_CHUNKS
