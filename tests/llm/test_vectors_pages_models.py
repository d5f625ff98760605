"""kNN and WARC against plain computations; language and toxicity against held-out labels and their definitions."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from affinis.llm import knn, language_crf, toxicity, warc
from affinis.llm.common import scratch_path, table
from tests.llm.plain import DOCS, edge_documents, sorted_rows

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, dim int, cell int"


def vectors(seed=0, n=120, dim=4):
    dice = random.Random(seed)
    rows = [(i, [round(dice.uniform(-1, 1), 1) for _ in range(dim)], 0, 1, 2) for i in range(n)]
    rows += [(200, None, 0, 1, 2), (220, [None] * dim, 0, 1, 2), (221, [math.nan] * dim, 0, 1, 2), (240, [math.inf, 0.0, 0.0, 0.0], 0, 1, 2)]
    rows += [(300 + i, rows[7][1], 0, 1, 2) for i in range(40)]  # one very common vector
    rows += [rows[3], (None, rows[5][1], 0, 1, 2), (400, [0.5, 0.5], 0, 1, 2), (420, [0.25, 1.0], 0, 1, 2), (440, [], 0, 1, 2)]
    return rows


def plain_knn(rows, k):
    seen = {(i, tuple(np.float32(x) for x in v)) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in seen]
    out = []
    for q, a in whole:
        if q is None or q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in whole if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("pivot_queries,block", [(512, 32_768), (2, 16)])
def test_knn(spark, monkeypatch, pivot_queries, block):
    monkeypatch.setattr(knn, "PIVOT_QUERIES", pivot_queries)
    monkeypatch.setattr(knn, "DATA_BLOCK", block)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3 if block == 16 else 1024)
    from pyspark.sql import functions as F

    rows = vectors()
    found = knn.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 20 == 0, k=20)
    assert sorted_rows(found.collect()) == sorted_rows(plain_knn(rows, 20))


def test_knn_prunes_what_no_query_needs():
    pivot = np.array([100.0, 0.0])
    data = np.array([[90.0, 5.0], [-90.0, 3.0]])
    low, high = knn._ends(data, np.sqrt((data**2).sum(1)), pivot, 10.0)
    assert low[0] > high[1]


def test_knn_large_components(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2.0**40, 1.0]), (20, [-(2.0**39), 3.0]), (3, [2.0**41, 1e300])]
    found = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    score = {(r.query_id, r.vec_id): r.score for r in found}
    assert score[0, 20] == max(-(2**63), -(2**46) * 2**45 + 64 * 192) and score[0, 3] == 2**63 - 1


def test_knn_empty(spark):
    from pyspark.sql import functions as F

    assert knn.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


# WARC

PAGES = "page_id long, url string, html string, payload string, same string, n int, revisits string"


def pages():
    dice = random.Random(9)
    rows = [(i, f"http://h/{i} ü%\r\n", "".join(dice.choice("<p>ab é") for _ in range(dice.randint(0, 3000))), *["c"] * 2, 1, "c") for i in range(60)]
    rows += [(100 + i, None, rows[4][2], *["c"] * 2, 1, "c") for i in range(20)] + [(2, None, rows[50][2], *["c"] * 2, 1, "c")]
    rows += [(200, "u", None, *["c"] * 2, 1, "c"), (201, "u", "", *["c"] * 2, 1, "c"), (None, "u", rows[6][2], *["c"] * 2, 1, "c")]
    rows += [rows[10], rows[10], (None, None, "alone", *["c"] * 2, 1, "c"), (300, "u", "x" * 3_000_000, *["c"] * 2, 1, "c")]
    return rows


def plain_warc(rows, least=0):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        refers = first.get(html or "") if len(payload) >= least else page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = refers is not None and refers != page_id
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", refers if revisit else None))
    return out


@pytest.mark.parametrize("range_bytes,least", [(150, 0), (1 << 22, 100)])
def test_warc_round_trip(spark, monkeypatch, range_bytes, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    rows = pages()
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), scratch_path(spark, "warc-test"), least)
    found = warc.read_warc(spark, manifest, range_bytes).collect()
    assert sorted_rows((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == sorted_rows(plain_warc(rows, least))
    html, url = {(r[0], r[2] or "") for r in rows}, {(r[0], r[1]) for r in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in html for r in found if r.record_type == "response")
    assert {(r.page_id, r.url) for r in found} == url
    # each file is a plain gzip file of WARC records
    for r in manifest.collect():
        data = gzip.open(r.path.removeprefix("file:")).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"\r\n\r\nWARC/1.1\r\n") == r.records - 1


def test_warc_false_magic_and_damage(tmp_path):
    good = warc.member(warc.record(1, "u", b"hello", False, None, "d"))
    noise = warc.MAGIC + b"\x00no member" + warc.MAGIC
    (tmp_path / "a").write_bytes(noise + good + noise + good)
    size = (tmp_path / "a").stat().st_size
    for cut in range(0, size, 7):
        found = []
        for start, end in ((0, cut), (cut, size)):
            with open(tmp_path / "a", "rb") as f:
                found += warc.members(f, start, end)
        assert len(found) == 2 and all(warc.parse(d, True)[6] == b"hello" for d in found)
    bad = zlib.decompressobj(31).decompress(good).replace(b"hello", b"hullo")
    with pytest.raises(ValueError):
        warc.parse(bad, True)


def test_warc_empty(spark):
    manifest = warc.write_warc(spark.createDataFrame([], PAGES), scratch_path(spark, "warc-test"))
    assert warc.read_warc(spark, manifest).collect() == []


# language


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_documents(), DOCS).repartition(3)


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    found = language_crf.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    apart = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.98 * len(apart)


def test_language_reads_text_alone(spark):
    """Labels of held-out rows change nothing."""
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(away, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted_rows(language_crf.language(docs).collect()) == sorted_rows(language_crf.language(other).collect())


def test_language_switching():
    """Forward-backward gives the marginals of the chain, and learned transitions tell the parts of a text apart."""
    texts = [("aba baba abab " * 30).encode(), ("xyx yxyx xxyy " * 30).encode()]
    field = language_crf.Field(["a", "x"])
    field.fit(language_crf.switched(texts * 4, np.array([0, 1] * 4)))
    ids, begin, _ = language_crf.features([b"abab aba q baba xyx q yxyx"])
    e = field.emissions(ids, begin)
    found, _ = field.marginals(e.copy(), np.array([0]), np.array([len(begin)]))
    assert found.argmax(1).tolist()[:2] == [0, 0] and found.argmax(1).tolist()[-1] == 1
    # against the sum over all paths
    import itertools

    p, total = np.zeros_like(found), 0.0
    for path in itertools.product(range(2), repeat=len(begin)):
        w = math.exp(sum(float(e[t, k]) for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, k in enumerate(path):
            p[t, k] += w
    assert np.allclose(found, p / total, atol=1e-4)


def test_language_edges(spark, edge):
    found = {(r.doc_id, r.lang_pred, r.score) for r in language_crf.language(edge).collect()}
    texts = {r.doc_id: r.text for r in edge.collect()}
    for doc_id, lang, score in found:
        if doc_id is not None and texts[doc_id] in (None, "", " \n\t ", "..."):
            assert (lang, score) == ("und", 0.0)
    assert {lang for _, lang, _ in found} <= {"und", "en", "de"}
    kept = language_crf.in_a_language(edge)
    assert kept.schema == edge.schema and kept.count() == sum(r.lang_pred != "und" for r in language_crf.language(edge).collect())
    nothing = spark.createDataFrame([], DOCS)
    assert language_crf.language(nothing).collect() == [] and language_crf.in_a_language(nothing).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_crf.language(unlabelled).collect()] == [("und", 0.0)]


# toxicity


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    found = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    # a tenth of these labels are on texts that hold one repeated word or punctuation
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)


def test_toxicity_pairs():
    """An exclusive pair of terms, which no weights of single terms can tell apart."""
    n = 400
    rows = [(i % 2, i // 2 % 2) for i in range(n)]
    text = np.array([i for i, r in enumerate(rows) for t in (0, 1) if r[t]])
    place = np.array([t for r in rows for t in (0, 1) if r[t]])
    label = np.array([float(a and b) - 0 if (a or b) else 1.0 for a, b in rows])  # both or neither
    machine = toxicity.Machine(2)
    machine.fit(n, text, place, label, rounds=300, batch=32)
    assert ((machine.margin(n, text, place) > 0) == (label == 1)).all()
    v = machine.v
    assert np.allclose(machine.margin(1, np.array([0, 0]), np.array([0, 1]))[0], machine.bias + machine.w.sum() + v[0] @ v[1])


def test_toxicity_edges(spark, edge):
    ids = [r.doc_id for r in edge.collect()]
    labels = spark.createDataFrame([(i, None if i is None or i % 7 == 0 else i % 2, "c") for i in ids], "doc_id long, toxic int, score string")
    found = toxicity.toxicity(edge, labels).collect()
    assert len(found) == len(ids) and all(0 <= r.score <= 1 for r in found)
    nothing = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(nothing, labels).collect() == []
    assert {r.score < 0.5 for r in toxicity.toxicity(edge, labels.limit(0)).collect()} == {True}
