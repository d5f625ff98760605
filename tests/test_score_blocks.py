"""What a block of the index lets out of a task: the best of each text by rounded score and id, on every path."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis import session
from affinis.operators import scoring


def block_of(rng, institutions: int, terms: int) -> tuple[scoring.IndexBlock, np.ndarray]:
    """Few terms that nearly all institutions have and that weigh next to nothing, many that few have."""
    weights = np.zeros((terms, institutions))
    for term in range(terms):
        has = rng.random(institutions) < (0.9 if term < 5 else 4 / institutions)
        weights[term, has] = rng.choice([0.1, 0.2, 0.3], has.sum()) * (1e-4 if term < 5 else 1)
    term, inst = np.nonzero(weights)
    df = (weights > 0).sum(axis=1)[term]
    table = {"term": term, "inst_id": inst * 3, "weight": weights[term, inst], "idf": np.ones(len(term)), "df": df}
    return scoring.IndexBlock(pa.table(table)), weights


@pytest.mark.parametrize("institutions", [7, 400])
def test_a_block_lets_out_the_best_of_each_text(institutions, monkeypatch):
    monkeypatch.setattr(scoring, "DENSE_CELLS", 1000)
    rng, k = np.random.default_rng(3), 20
    block, weights = block_of(rng, institutions, 300)
    texts = [np.sort(rng.choice(300, rng.integers(1, 40), replace=False)) for _ in range(60)] + [np.arange(5), np.arange(300)]
    flat, sizes = np.concatenate(texts), [len(t) for t in texts]
    text, place = block.known(np.repeat(np.arange(len(texts)), sizes), flat)
    length = np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))
    row, inst, sums = block.best(text, place, length, k)
    assert np.bincount(row).max() <= k + 2  # ties by the thousand stay in the task
    for at, terms in enumerate(texts):
        full = weights[terms].sum(axis=0)
        want = sorted((-round(s / length[at], 6), i * 3) for i, s in enumerate(full) if s > 0)[:k]
        got = sorted((-round(s / length[at], 6), i) for i, s in zip(inst[row == at], sums[row == at]))[:k]
        assert got == want, at


def test_scores_round_as_spark_does(spark):
    values = [0.0, 0.1234565, 0.1234555, 1.0, 2.5e-07, 5e-07, 4.9999999e-07, 0.0000015, 1 / 3, math.sqrt(0.5)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", F.round("v", 6).alias("r"))
    assert scoring._rounded(np.array(values)).tolist() == [r.r for r in sorted(frame.collect())]


def test_texts_are_dealt_once_and_the_index_is_not_copied(spark, capsys):
    train = spark.createDataFrame([(i, f"site{i} town{i % 5}") for i in range(50)], "inst_id bigint, text string")
    index = session.materialize(scoring.fit_score_index(train, "basic"))
    texts = spark.createDataFrame([(i, f"site{i} town{i % 7}") for i in range(60)] + [(60, None), (61, ""), (62, "unseen")], "text_id bigint, text string")
    scored = scoring.score_texts(texts, index, "basic")
    capsys.readouterr()
    scored.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "CoGroup" not in plan and "Window" not in plan, plan
    by_text = {}
    for r in scored.collect():
        by_text.setdefault(r.text_id, []).append((r["rank"], r.inst_id, r.score))
    assert sorted(by_text[3])[0][1] == 3 and [r for r, *_ in sorted(by_text[3])] == list(range(1, 11))
    assert not {60, 61, 62} & by_text.keys() and abs(sum(s for *_, s in by_text[3]) - 1) < 1e-5
