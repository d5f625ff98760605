"""Grams that have many contexts over all blocks, but few in each."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import byte_repeats, repeats, word_repeats
from affinis.llm.suffix_structures import array_classes, automaton_classes
from tests.llm.plain import later_windows, sorted_rows

BYTES = repeats.Plan(words=False, length=50, gram=20, within=False, classes=array_classes, block_bytes=1 << 19)
WORDS = repeats.Plan(words=True, length=20, gram=8, within=True, classes=automaton_classes, block_bytes=2 << 20)


@pytest.mark.parametrize("plan", [BYTES, WORDS])
def test_many_contexts_in_all(plan):
    n = 30_000
    asked = np.zeros(n + 3, plan.asked)  # one gram with a context in each of many blocks, and one with three
    asked["gram"][n:] = 7
    asked["context"], asked["doc"] = np.arange(1, n + 4), np.arange(n + 3)
    chunks = pa.array(np.arange(n + 3) // 10)
    table = pa.table({"chunk": chunks.take(pa.array(np.arange(0, n + 3, 10))), "payload": [asked[i : i + 10].tobytes() for i in range(0, n + 3, 10)]})
    out = repeats._answers(plan)((pa.scalar(0),), table)
    told = np.frombuffer(b"".join(out.column("payload").to_pylist()), plan.answered)
    assert (told["kind"] == 2).sum() == n  # window by window
    assert (told["kind"] == 1).sum() == 3


@pytest.mark.parametrize("words", [False, True])
def test_shared_line_over_small_blocks(spark, monkeypatch, words):
    monkeypatch.setattr(repeats, "HOT_IN_ALL", 30, raising=False)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 16)
    dice = random.Random(1)
    line = " ".join(dice.choices([f"l{i}" for i in range(50)], k=25))
    rows = []
    for i in range(150):
        own = [dice.choices([f"w{k}" for k in range(900)], k=20) for _ in range(2)]
        rows.append((i, " ".join([*own[0], line, *own[1]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.without_repeats(docs, replace(WORDS if words else BYTES, block_bytes=800)).drop("kept")
    want = later_windows(rows, 20 if words else 50, words)
    assert sorted_rows(found.collect()) == sorted_rows(want)
    query = word_repeats.dedup_words(docs) if words else byte_repeats.dedup_bytes(docs)
    assert sorted_rows(query.select("doc_id", "kept_sha256").collect()) == sorted_rows((w[0], w[4]) for w in want)
