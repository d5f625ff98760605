"""Exact dedup, SimHash, substring dedup, BPE and mixing against plain computations."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash

from affinis.llm import bpe, byte_repeats, exact_dedup, mixing, repeats, simhash, suffix_structures, word_repeats
from affinis.llm.queries import tokenizer_path
from tests.llm.plain import DOCS, edge_documents, later_windows, sorted_rows


@pytest.fixture(scope="module")
def rows():
    return edge_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# exact dedup


def plain_dedup(rows):
    groups = defaultdict(list)
    for n, r in enumerate(rows):
        groups["".join(c for c in r[1] or "" if c not in " \t\n\v\f\r")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, n, r[0]))
    out = []
    for normal, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), m == best, hashlib.sha256(normal.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_keys", [1, 1024])
def test_exact_groups(docs, rows, bucket_keys, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 2000)
    assert sorted_rows(exact_dedup.dedup_groups(docs, bucket_keys).collect()) == sorted_rows(plain_dedup(rows))


def test_exact_rows_keep_their_columns(docs, rows):
    kept = exact_dedup.deduplicated(docs)
    assert kept.schema == docs.schema
    want = Counter((r[0], r[4]) for r in plain_dedup(rows) if r[3])
    assert Counter((r.doc_id, hashlib.sha256("".join((r.text or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}).encode()).hexdigest()) for r in kept.collect()) == want


def test_exact_empty(none):
    assert exact_dedup.dedup_groups(none).collect() == [] and exact_dedup.deduplicated(none).collect() == []


def test_colliding_keys_stay_apart():
    batch = pa.RecordBatch.from_pydict({
        "key": [7, 7, 7, 9], "entry": [1, 2, 3, 4], "normal": [b"a", b"b", b"a", b"a"], "copies": [2, 1, 3, 1],
        "best_points": [5, 5, 9, 1], "best_id": [1, 2, 3, 4], "best_row": [1, 2, 3, 4],
    })
    found = [r for b in exact_dedup._owners([batch]) for r in b.to_pylist()]
    assert {r["entry"]: (r["keep_id"], r["group_size"]) for r in found} == {1: (3, 5), 3: (3, 5), 2: (2, 1), 4: (4, 1)}


# SimHash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, roots=False):
    """prints: (doc_id, fingerprint) -> component of each row."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    if roots:
        return {find(p) for _, p in prints}
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least.get(find(p))) for doc_id, p in prints]


def test_near_groups(docs, rows):
    want = plain_components([(r[0], plain_print(r[1])) for r in rows])
    assert sorted_rows(simhash.near_groups(docs).collect()) == sorted_rows(want)


def test_near_rows_one_of_each_group(docs, rows):
    kept = simhash.near_deduplicated(docs)
    assert kept.schema == docs.schema
    assert kept.count() == len(plain_components([(r[0], plain_print(r[1])) for r in rows], roots=True))


@pytest.mark.parametrize("segments,distance", [(5, 2), (7, 2), (9, 2), (4, 3), (64, 2)])
def test_pigeonring_loses_no_link(spark, segments, distance):
    dice = random.Random(segments)
    prints = {dice.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):
            q = p
            for _ in range(dice.randint(1, 4)):
                q ^= 1 << dice.randrange(64)
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), distance, segments).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_components_of_a_path(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {tuple(r) for r in simhash.components(edges).collect()}
    assert found == {(i, 0) for i in range(1, n)} | {(1001, 1000)}


def test_near_empty(none):
    assert simhash.near_groups(none).collect() == [] and simhash.near_deduplicated(none).collect() == []


# substring dedup


def noisy(seed, n=40, letters="ab "):
    dice = random.Random(seed)
    rows = [(dice.randint(0, 30), "".join(dice.choice(letters) for _ in range(dice.randint(0, 80)))) for _ in range(n)]
    return rows + [(None, rows[3][1]), (None, None), (7, None), rows[5]]


@pytest.mark.parametrize("hot", [1, 3, 32])
@pytest.mark.parametrize("length", [1, 2, 5])
def test_words_on_dense_repeats(spark, monkeypatch, hot, length):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 4)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    rows = noisy(length)
    found = word_repeats.dedup_words(spark.createDataFrame(rows, "doc_id long, text string"), length)
    want = [(i, n, gone, digest) for i, n, gone, _, digest in later_windows(rows, length, True)]
    assert sorted_rows(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted_rows(want)


@pytest.mark.parametrize("hot,length", [(1, 6), (3, 6), (32, 9)])
def test_bytes_on_dense_repeats(spark, monkeypatch, hot, length):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 4)
    rows = noisy(length, letters="abé ")
    found = byte_repeats.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length)
    assert sorted_rows(found.collect()) == sorted_rows(later_windows(rows, length, False))


def test_repeats_on_documents(docs, rows):
    pairs = [(r[0], r[1]) for r in rows]
    assert sorted_rows(byte_repeats.dedup_bytes(docs).collect()) == sorted_rows(later_windows(pairs, 50, False))
    found = word_repeats.dedup_words(docs, with_text=True).collect()
    assert sorted_rows((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted_rows(
        (i, n, gone, digest) for i, n, gone, _, digest in later_windows(pairs, 20, True)
    )
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_repeats_empty(none):
    assert word_repeats.dedup_words(none).collect() == [] and byte_repeats.dedup_bytes(none).collect() == []


def test_suffix_array_and_classes():
    dice = random.Random(4)
    for _ in range(300):
        text = [dice.randint(1, dice.choice([1, 2, 4])) for _ in range(dice.randint(1, 40))] + [0]
        assert suffix_structures.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    import numpy as np

    for _ in range(150):
        length = dice.randint(1, 4)
        sequences = [np.array([dice.randint(0, 2) for _ in range(dice.randint(0, 12))], np.int64) for _ in range(5)]
        for classes in (suffix_structures.automaton_classes, suffix_structures.array_classes):
            seen, back = {}, {}
            for s, numbers in zip(sequences, classes(sequences, length)):
                assert len(numbers) == max(0, len(s) - length + 1)
                for i, number in enumerate(numbers):
                    window = tuple(s[i : i + length])
                    assert seen.setdefault(window, number) == number and back.setdefault(number, window) == window


# BPE


def plain_encoding(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_as_the_library(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_ROWS", 7)
    ids, texts = plain_encoding([r[1] for r in rows])
    want = [(r[0], list(i), t) for r, i, t in zip(rows, ids, texts)]
    encoded = bpe.encode(docs, tokenizer_path(), keep=("doc_id", "word", "chunk"))
    assert encoded.columns == ["doc_id", "word", "chunk", "ids"]
    found = bpe.decode(encoded, tokenizer_path()).collect()
    assert sorted_rows((r.doc_id, r.ids, r.decoded) for r in found) == sorted_rows(want)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted_rows(bpe.round_trip(docs, tokenizer_path()).collect()) == sorted_rows(
        (i, len(x), digest(" ".join(map(str, x))), digest(t)) for i, x, t in want
    )


def test_bpe_word_that_the_table_lacks(tmp_path):
    chunk = bpe._Chunk(bpe._tokenizer(tokenizer_path()), f"file://{tmp_path}", 5)
    ids, _ = plain_encoding(["Some words, some more."])
    assert chunk.encode(b"Some words, some more.").tolist() == ids[0]


def test_bpe_empty(none):
    assert bpe.round_trip(none, tokenizer_path()).collect() == [] and bpe.encode(none, tokenizer_path()).collect() == []


# mixing


def plain_mix(rows):
    size = [len((r[1] or "").encode().split()) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total, own = sum(size), {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, float(total)
    while open_:  # reshare until no target is above three times its source's size
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * own[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in over}
        left -= sum(3 * own[s] for s in over)
        open_ -= over
    entries = []
    for no, s in enumerate(sources):
        place = 0
        keyed = sorted((hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n, i) for i, (r, n) in enumerate(zip(rows, size)) if r[3] == s)
        for *_, n, i in keyed:
            place += n
            if n:
                entries += [(((c - 1) * own[s] + place) / target[s], no, c, place, i) for c in (1, 2, 3)]
    taken, running = Counter(), 0
    for *_, i in sorted(entries):
        running += size[i]
        if running > total:
            break
        taken[i] += size[i]
    return [(r[0], n, own[r[3]], target[r[3]], taken[i]) for i, (r, n) in enumerate(zip(rows, size))]


def test_mix(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 3)
    found = sorted_rows(mixing.mix(docs).collect())
    want = sorted_rows(plain_mix(rows))
    assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * b[3] for a, b in zip(found, want))
    assert found == sorted_rows(mixing.mix(docs.repartition(5)).collect())


def test_mix_rows(docs, rows):
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert words == sum(r[4] for r in plain_mix(rows))


def test_mix_comes_near_targets(spark):
    dice = random.Random(2)
    rows = [(i, "w " * dice.randint(1, 40), None, dice.choice(["a"] * 8 + ["b", "c", "d"])) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ("doc_id", "source")).collect()
    target, taken = {r.source: r.target for r in found}, Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert all(abs(taken[s] - t) <= 80 for s, t in target.items())


def test_mix_empty(spark, none):
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted_rows(mixing.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
