"""Benchmark decontamination against every window of every item, and suffix arrays against sorted suffixes."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import decontaminate, queries
from tests.llm.plain import DOCS, WORDS, edge_documents, sorted_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_marks(rows, items, window=10):
    """(doc_id, n_words, n_hit, n_items, sha256 of the items, contaminated) of each (doc_id, text)."""
    wanted = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            wanted.setdefault(tuple(own[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(own) - size + 1):
                names = wanted.get(tuple(own[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def made(seed=0):
    """Edge documents with passages of the items planted, cut short, changed and run together."""
    dice = random.Random(seed)
    items = [(n, " ".join(dice.choice(WORDS) for _ in range(dice.choice([3, 9, 10, 11, 25, 40])))) for n in range(30)]
    items += [(None, "Straße Ünï 漢字 x1 2y"), (7, items[3][1]), (101, items[5][1]), (102, ""), (103, None), (104, "... !"), (None, "oak"), (105, "Rowan, pine-oak ASH!")]
    docs = [(r[0], r[1]) for r in edge_documents(seed)]
    for n in range(80):
        text = [dice.choice(WORDS) for _ in range(dice.randint(0, 30))]
        own = (dice.choice(items)[1] or "").split()
        lost = dice.choice([0, 0, 1, 5])
        text += [w.upper() for w in own[: len(own) - lost]] + [dice.choice(WORDS)]
        docs.append((1000 + n, dice.choice([" ", ", ", "\n", "--"]).join(text)))
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = made()
    extra = len(DOCS.split(", ")) - 2
    return (
        spark.createDataFrame([(*r, *[None] * extra) for r in docs], DOCS).repartition(3),
        spark.createDataFrame([(*i, "c", "c") for i in items], "item_id long, text string, doc_id string, n string"), docs, items,
    )


def test_documents(frames):
    docs, benchmark, rows, items = frames
    got = decontaminate.contamination(docs, benchmark)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain_marks(rows, items)
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert 30 < sum(r[5] for r in want) < len(want)


def test_affected_documents_go(frames):
    docs, benchmark, rows, items = frames
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.schema == docs.schema
    want = Counter((d, t) for (d, t), mark in zip(rows, plain_marks(rows, items)) if not mark[5])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


@pytest.mark.parametrize("sizes", [(200, 7, 12), (10**6, 50, 10**6), (3000, 10**6, 1)])
def test_shards_and_blocks_change_nothing(spark, frames, tmp_path, monkeypatch, sizes):
    docs, items = made(1)
    _, benchmark, _, _ = frames
    folder, longest = decontaminate._stored(spark.createDataFrame(items, "item_id long, text string"))
    for name, value in zip(("BLOCK_BYTES", "SHARD_WORDS", "ITEM_WORDS"), sizes):
        monkeypatch.setattr(decontaminate, name, value)
    docs = [d for d in docs if len(d[1] or "") < 5000]
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in docs], "keep_doc_id": [d for d, _ in docs]})
    got = [tuple(r.values()) for b in decontaminate._marked(folder, min(10, longest), 10, ["keep_doc_id"])([batch]) for r in b.to_pylist()]
    assert sorted_rows(got) == sorted_rows(plain_marks(docs, items))


def test_no_benchmark_or_documents(spark, frames):
    docs, benchmark, rows, items = frames
    got = decontaminate.contamination(docs, benchmark.limit(0)).collect()
    assert sorted_rows(got) == sorted_rows(plain_marks(rows, []))
    assert decontaminate.contamination(docs.limit(0), benchmark).collect() == []
    assert decontaminate.longest_matches(docs, benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("units", [[], [0], [1, 1, 1, 1, 0, 1, 1, 0], [3, 1, 2, 0, 3, 1, 2, 3, 1, 0]])
@pytest.mark.parametrize("depth", [1, 2, 3, 5, 20])
def test_array_of_few(units, depth):
    array = decontaminate.SuffixArray(np.array(units, np.int32), depth)
    padded = units + [0] * depth
    assert sorted(array.order.tolist()) == list(range(len(units)))
    prefixes = [padded[i : i + depth] for i in array.order]
    assert prefixes == sorted(prefixes)


def test_array_and_search_of_many():
    dice = random.Random(6)
    for top in (2, 5, 10**6):
        units = [dice.choice([0, dice.randint(1, top), 1, 2]) for _ in range(3000)]
        units += units[100:400]
        array = decontaminate.SuffixArray(np.array(units, np.int32), 64)
        padded = units + [0] * 64
        prefixes = [padded[i : i + 64] for i in array.order]
        assert prefixes == sorted(prefixes)
        tests = units[500:560] + [0] + [1, 2, 1, 1] + [0]
        at = np.full(len(tests), 3)
        length, low, high, first, last = array.search(np.array(tests), at)
        for i in range(len(tests)):
            own = tests[i : tests.index(0, i)]
            best = max(n for n in range(len(own) + 1) if n == 0 or any(units[p : p + n] == own[:n] for p in range(len(units))))
            assert length[i] == best
            if best:
                assert sorted(array.order[low[i] : high[i]].tolist()) == [p for p in range(len(units)) if units[p : p + best] == own[:best]]
            places = [p for p in range(len(units)) if len(own) >= 3 and units[p : p + 3] == own[:3]]
            assert sorted(array.order[first[i] : last[i]].tolist()) == places


def test_longest_matches(spark):
    dice = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(n, " ".join(dice.choices(vocabulary, k=30))) for n in range(5)]
    docs = []
    for n in range(60):
        own = dice.choice(items)[1].split()
        begin = dice.randint(0, 20)
        docs.append((n, " ".join(dice.choices(vocabulary, k=dice.randint(0, 9)) + own[begin : begin + dice.randint(5, 25)] + dice.choices(vocabulary, k=5))))
    docs.append((60, docs[3][1]))
    want = set()
    for item, text in items:
        own = text.split()
        for start in range(len(own) - 9):
            found = {}
            for doc_id, other in docs:
                other = other.split()
                for p in range(len(other)):
                    n = 0
                    while start + n < len(own) and p + n < len(other) and own[start + n] == other[p + n]:
                        n += 1
                    found[doc_id, p] = n
            best = max(found.values())
            if best >= 10:
                want |= {(str(item), start, best, d, p) for (d, p), n in found.items() if n == best}
    got = decontaminate.longest_matches(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    )
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_marks(rows, items)
    assert any(r[5] for r in want)
    assert sorted_rows(queries.op12_decontaminate(spark, sf).collect()) == sorted_rows(want)
