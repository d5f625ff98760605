import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis import session
from affinis.operators import balance, dims, features, matching, relational, scoring, synth
from affinis.operators.skew import salted_lookup, skew_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_skew_join_equals_plain_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame(
        [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), "x") for i in range(500)], "row int, k int, v string")
    right = spark.createDataFrame([(k, f"n{k}{j}") for k in (1, 2, 4) for j in range(2)], "k int, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how)
        salted = skew_join(left, right, ["k"], how, spread=["row"], salts=4, min_rows=1)
        assert rows(salted.select(plain.columns)) == rows(plain), how
        if how != "left_anti":
            looked = salted_lookup(left, right, "k", how, ["row"], 4)
            assert rows(looked.select(plain.columns)) == rows(plain), how


def test_balance(spark):
    data = [(1, f"a{i}") for i in range(3)] + [(2, f"b{i}") for i in range(10)] + [(3, f"c{i}") for i in range(40)] + [(4, "d")]
    df = spark.createDataFrame(data, "id int, t string")
    got = balance.balance_per_id(df, "id", "t", n=10, extra=5).collect()
    per_id = {i: [r.t for r in got if r.id == i] for i in (1, 2, 3, 4)}
    assert {i: len(v) for i, v in per_id.items()} == {1: 10, 2: 10, 3: 15, 4: 10}
    assert set(per_id[1]) == {"a0", "a1", "a2"} and len(set(per_id[3])) == 15
    single = balance.balance_per_id(df, "id", "t", n=10, extra=5, mode="single").filter("id = 1").collect()
    assert len(single) == 10 and len({r.t for r in single}) == 1
    low = balance.upsample_replace(df, "id", "t", 10).groupBy("id").count()
    assert rows(low) == [(1, 10), (4, 10)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = balance.balance_per_id(df, "id", "t", n=10, extra=5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_dense_index_and_batches(spark):
    df = spark.range(1100).select(F.col("id"), F.when(F.col("id") < 1000, "train").otherwise("val").alias("split"))
    indexed = features.dense_index(df, ["id"], ["split"])
    got = {k: sorted(r.idx for r in indexed.filter(F.col("split") == k).collect()) for k in ("train", "val")}
    assert got == {"train": list(range(1000)), "val": list(range(100))}
    batches = features.full_batches(features.dense_index(df, ["id"]), 512).groupBy("batch").count()
    assert rows(batches) == [(0, 512), (1, 512)]
    assert features.full_batches(features.dense_index(df, ["id"]), 512, drop_last=False).count() == 1100
    labels = rows(features.label_index(spark.createDataFrame([(5,), (5,), (-1,), (9,), (None,)], "inst_id bigint")))
    assert sorted(r[1] for r in labels) == [0, 1, 2] and (-1, 0) in labels


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=6), st.lists(st.text("ab ", min_size=1, max_size=40), min_size=1, max_size=6))
def test_join_contains_equals_brute_force(spark, texts, names):
    # whole pieces of the texts as names, so that matches of all lengths occur
    for t, n in itertools.islice(itertools.product(texts, (3, 6, 9, 16, 33)), 12):
        if len(t) >= n:
            names = names + [t[len(t) - n:]]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame(list(enumerate(names)), "j int, n string")
    expected = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(names) if y in x)
    assert rows(matching.join_contains(t, n, "i", "t", "j", "n")) == expected


def test_join_contains_candidates(spark):
    c = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "text_id int, inst_id int")
    t = spark.createDataFrame([(1, "xUniversityAx"), (2, "nothing")], "text_id int, clean string")
    n = spark.createDataFrame([(10, "UniversityA"), (11, "UniversityB")], "inst_id int, name string")
    assert rows(matching.join_contains_candidates(c, t, n)) == [(1, 10, "UniversityA")]


def plain_scores(train, texts, terms_of, k=20):
    """Cosines of tf-idf vectors over all pairs."""
    tf, n = Counter(), len({i for i, _ in train})
    for i, t in train:
        tf.update((i, w) for w in terms_of(t))
    df = Counter(w for _, w in tf)
    raw = {(i, w): (1 + math.log(c)) * round(math.log(n / df[w]), 6) for (i, w), c in tf.items() if df[w] < n}
    norm = Counter()
    for (i, _), v in raw.items():
        norm[i] += v * v
    out = {}
    for text_id, t in texts:
        known = [w for w in terms_of(t) if 0 < df[w] < n]
        idf = {w: round(math.log(n / df[w]), 6) for w in known}
        length = math.sqrt(sum(v * v for v in idf.values()))
        sums = Counter()
        for (i, w), v in raw.items():
            if w in idf:
                sums[i] += round(v / math.sqrt(norm[i]), 6) * idf[w]
        best = sorted(((-round(s / length, 6), i) for i, s in sums.items()))[:k]
        out[text_id] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return out


def test_scorers_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    train = [(i, " ".join(rng.sample(words, 6))) for i in range(70) for _ in range(2)]
    texts = [(i, " ".join(rng.sample(words, 5) + ["unseen"])) for i in range(30)]
    cut = {"basic": lambda t: set(t.split()), "lang": lambda t: {f" {t} "[i:i + 4] for i in range(len(t) - 1)}}
    frame = spark.createDataFrame(texts, "text_id bigint, text string")
    for model in ("basic", "lang"):
        index = session.materialize(scoring.fit_score_index(spark.createDataFrame(train, "inst_id bigint, text string"), model))
        expected = plain_scores(train, texts, cut[model])
        for blocks, parts in ((1_000_000, 20_000), (50, 7), (20, 20_000)):
            monkeypatch.setattr(scoring, "BLOCK_INSTITUTIONS", 20_000 if blocks > 20 else 5)
            monkeypatch.setattr(scoring, "INDEX_BLOCK_ROWS", blocks)
            monkeypatch.setattr(scoring, "TEXT_PART_ROWS", parts)
            got = scoring.score_texts(frame, index, model, sharpness=None).collect()
            assert sorted((r.text_id, r["rank"], r.inst_id) for r in got) == sorted((t, a, b) for t, v in expected.items() for a, b, _ in v)
            assert all(abs(r.score - expected[r.text_id][r["rank"] - 1][2]) < 2e-6 for r in got)


def test_blocks_out_of_reach_are_skipped(spark, monkeypatch):
    """Institutions in clusters of their own terms: a text is scored in few blocks, with the same result."""
    rng = random.Random(9)
    train = [(i, f"topic{i // 60} site{i % 7} " + " ".join(rng.sample([f"c{i // 60}x{w}" for w in range(30)], 5))) for i in range(1200)]
    texts = [(i, f"topic{i % 20} site{rng.randrange(7)} " + " ".join(rng.sample([f"c{i % 20}x{w}" for w in range(30)], 4))) for i in range(80)]
    index = session.materialize(scoring.fit_score_index(spark.createDataFrame(train, "inst_id bigint, text string"), "basic"))
    frame = spark.createDataFrame(texts, "text_id bigint, text string")
    expected = plain_scores(train, texts, lambda t: set(t.split()))
    monkeypatch.setattr(scoring, "BLOCK_INSTITUTIONS", 60 * 8)
    monkeypatch.setattr(scoring, "INDEX_BLOCK_ROWS", 600)
    report = {}
    got = scoring.topk_candidates(scoring.term_scores(frame, index, "basic", report=report)).collect()
    assert sorted((r.text_id, r["rank"], r.inst_id) for r in got) == sorted((t, a, b) for t, v in expected.items() for a, b, _ in v)
    assert report["scored"] < report["pairs"] / 3, report


def test_frequent_terms_are_enough(spark):
    """A text whose terms all belong to very many institutions still finds the one that has all of them."""
    train = [(i, f"alpha{i % 2} beta{i // 2 % 2} gamma{i // 4 % 2}" if i else "delta") for i in range(1, 2401)] + [(0, "delta")]
    train.append((2401, "alpha0 beta1 gamma1 alpha1"))
    index = session.materialize(scoring.fit_score_index(spark.createDataFrame(train, "inst_id bigint, text string"), "basic"))
    texts = spark.createDataFrame([(1, "gamma1 alpha1 alpha0 beta1")], "text_id bigint, text string")
    assert scoring.score_texts(texts, index, "basic").filter("rank = 1").collect()[0].inst_id == 2401
    assert index.agg(F.max("df")).collect()[0][0] > 1000


def test_shard_names_are_never_cut(spark):
    df = spark.range(12_345).select("id")
    shards = features.shard_rows(df, ["id"], 1).groupBy("shard").count().collect()
    assert len(shards) == 12_345 and {len(r.shard) for r in shards} == {4, 5}
    few = features.dense_index(spark.range(500).select("id"), ["id"], bucket_rows=3)
    assert rows(few) == rows(features.dense_index(spark.range(500).select("id"), ["id"]))


def test_join_contains_short_names(spark):
    texts = [(i, t) for i, t in enumerate(["abcd", "bcda abc", "d", "", "aaaa", "cab dab"])]
    names = [(i, n) for i, n in enumerate(["a", "d", "ab", "bc", "aa", "abc", "cda", "abcd", "dab", "aaaa", "z", " "])]
    got = matching.join_contains(
        spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(names, "j int, n string"), "i", "t", "j", "n")
    assert rows(got) == sorted(((i, j) for i, t in texts for j, n in names if n in t), key=repr)


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())
